"""Interval joins and request batches against plain versions, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from siltwork.operators import evaluation, intervals, vectors

RANGES = "id int, file string, start_line int, end_line int"


def ranges(rng, n, files, longest):
    rows = []
    for i in range(n):
        s = rng.randrange(-50, 400)
        rows.append((i, rng.choice(files), s, s + rng.choice([0, 1, 3, 4, 15, 16, rng.randrange(longest)])))
    return [*rows, (n, None, 1, 5), (n + 1, files[0], None, 5), (n + 2, files[0], 9, 8), (n + 3, files[0], 1, 1)]


@pytest.mark.parametrize("bound", [intervals.PAIRS, 40])
def test_pairs_against_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(intervals, "PAIRS", bound)
    rng = random.Random(1)
    a, b = ranges(rng, 150, ["x", "x", "x", "y"], 300), ranges(rng, 120, ["x", "x", "z"], 60)
    left, right = spark.createDataFrame(a, RANGES), spark.createDataFrame(b, RANGES)
    ok = lambda r: None not in r and r[2] <= r[3]
    meets = {(p[0], q[0]) for p in a for q in b if ok(p) and ok(q) and p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3]}
    inside = {(p[0], q[0]) for p in a for q in b if ok(p) and ok(q) and p[1] == q[1] and p[2] >= q[2] and p[3] <= q[3]}
    for contained, want in ((False, meets), (True, inside)):
        got = [(r["left"]["id"], r["right"]["id"]) for r in intervals.pairs(left, right, ["file"], contained).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        hit = {r["id"] for r in intervals.marked(left, right, ["file"], contained).where("hit").collect()}
        assert hit == {p for p, _ in want}
    assert intervals.marked(left, right, ["file"]).count() == len(a)
    assert intervals.pairs(left.limit(0), right, ["file"]).count() == 0


def test_a_long_range_is_a_few_rows(spark):
    left = spark.createDataFrame([(0, "x", 1, 1 << 30)], RANGES)
    right = spark.createDataFrame([(i, "x", i * 1000, i * 1000 + 2) for i in range(500)], RANGES)
    side = intervals._side(right, ["file"], "start_line", "end_line", "b")
    assert intervals._binned(side, "b", F.array(F.lit(1), F.lit(15))).count() <= 4 * 500
    assert intervals.pairs(left, right, ["file"]).count() == 500 and intervals.pairs(right, left, ["file"], contained=True).count() == 499


def test_a_hot_bin_is_split(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PAIRS", 1000)
    many = spark.range(400).selectExpr("id", "'x' AS file", "1 AS start_line", "4 AS end_line")
    a = intervals._binned(intervals._side(many, ["file"], "start_line", "end_line", "a"), "a", F.array("__al"))
    b = intervals._binned(intervals._side(many, ["file"], "start_line", "end_line", "b"), "b", F.array("__bl"))
    met = intervals._met(a, b, ["__k0"], F.col("__bin") == 0)
    assert met.count() == 400 * 400 and met.select("__part").distinct().count() > 50


def test_citation_metrics_by_tables(spark):
    cited = spark.createDataFrame([("a", "f", 5, 9), ("a", "f", 20, 30), ("a", "g", 1, 2), ("b", "f", 1, 1), ("c", "f", 1, 2)], "case_id string, file_path string, start_line int, end_line int")
    units = spark.createDataFrame([("a", "f", 9, 12), ("a", "f", 50, 60), ("a", "g", None, None), ("a", "f", None, None), ("d", "f", 1, 2), ("b", "g", None, None)], cited.schema)
    sources = spark.createDataFrame([("a", "f", 1, 10), ("a", "g", 1, 1), ("c", "f", 1, 2)], cited.schema)
    got = {r["case_id"]: tuple(r)[1:] for r in evaluation.citation_metrics(cited, units, sources).collect()}
    assert got.keys() == {"a", "b", "c", "d"}
    assert got["a"][0] == pytest.approx(2 / 3) and got["a"][1] == pytest.approx(2 / 3) and got["a"][3] == pytest.approx(1 / 3)
    assert got["b"] == (0, 0, 0, 0) and got["c"] == (0, 0, 0, 1) and got["d"] == (0, 0, 0, 0)


def test_answer_metrics_by_tables(spark):
    said = spark.createDataFrame([("a", " The  Token\nBudget "), ("b", None), ("c", "x")], "case_id string, answer string")
    terms = spark.createDataFrame([("a", "1", "token budget"), ("a", "1", "none"), ("a", "2", "absent"), ("a", None, "THE"), ("a", None, "no"), ("b", "1", "x")], "case_id string, concept string, term string")
    grounded = spark.createDataFrame([("a", 0.75, 4), ("b", 1.0, 0)], "case_id string, groundedness double, citations int")
    got = {r["case_id"]: tuple(r)[1:] for r in evaluation.answer_metrics(said, terms, grounded).collect()}
    assert got == {"a": (0.5, 0.5, 0.25, 0.5), "b": (0.0, 0.0, 1.0, 1.0), "c": (1.0, 0.0, 1.0, 1.0)}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_batches_of_one_queue_over_many_partitions(spark, parts):
    rng = random.Random(parts)
    for queues in (1, 3, 60):
        rows = [(rng.randrange(queues) or None, i, rng.choice([0, 1, 5, 30, 99, 100, 101, 400])) for i in range(400)]
        want = {}
        for q in {r[0] for r in rows}:
            n = total = batch = 0
            for _, i, t in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
                if n >= 7 or (n and total + t > 100):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + t
                want[i] = batch
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = vectors.batches(spark.createDataFrame(rows, "q int, i int, t int"), ["q"], "i", "t", most=7, budget=100).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert {r["i"]: r["batch"] for r in got} == want and len(got) == 400
