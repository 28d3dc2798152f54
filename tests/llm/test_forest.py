import numpy as np
from pyspark.sql import functions as F

from siltwork.llm import forest

SCHEMA = "vec_id long, embedding array<double>, label int"


def cosines(x, q):
    x, q = np.asarray(x, float), np.asarray(q, float)
    return (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


def plain(rows, k, queries):
    """Exact neighbours, ties to the smaller id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        score = cosines(x, x[list(ids).index(q)]).round(13)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in best]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_on_the_given_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    exact = plain(rows, 5, [i for i, _ in rows if i % 50 == 0])
    found = result(forest.nearest(df, F.col("vec_id") % 50 == 0))
    assert set(found) == set(exact) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(v)) for q, v in exact.items()) >= 0.9 * 5 * len(exact)


def test_levels_and_shards_give_what_a_plain_forest_gives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 12))
    x = centres[rng.integers(0, 20, 600)] + 0.4 * rng.standard_normal((600, 12))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    trees, digits, cells, breadth = 6, 3, 16, 2.0
    bits, unit = digits * 5, forest._unit(x)
    labels = [forest.hashed(unit, t, digits, cells) for t in range(trees)]
    least, expected = int(np.ceil(breadth * np.sqrt(600))), {}
    for q in range(0, 600, 30):
        same = lambda level: [labels[t] >> (bits - level) == labels[t][q] >> (bits - level) for t in range(trees)]  # noqa: B023, E731
        level = max(level for level in range(bits + 1) if sum(s.sum() for s in same(level)) >= least or level == 0)
        near = [i for i in np.flatnonzero(np.any(same(level), axis=0)) if i != q]
        score = cosines(x[near], x[q])
        expected[q] = [near[i] for i in np.lexsort((near, -score))[:5]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    run = lambda: result(forest.nearest(df, F.col("vec_id") % 30 == 0, 5, trees, digits, cells, breadth))
    assert run() == expected
    monkeypatch.setattr(forest, "SHARD", 64)
    monkeypatch.setattr(forest, "SHARD_ROOT", 1)
    monkeypatch.setattr(forest, "LOT", 50)
    monkeypatch.setattr(forest, "GATHER", 3)
    assert run() == expected


def test_copies_ties_and_unsound_vectors(spark):
    big = [1e300, 0.0, 1e300]
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (50, big), (51, [1.0, 0.0, 1.0]),
        (52, None), (53, [0.0, 0.0, 0.0]), (54, [float("nan"), 1.0, 0.0]), (55, [float("inf"), 1.0, 0.0]), (56, []), (None, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (100, [1.0, 0.0]), (150, None), (57, [None, 1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("rank", F.lit("clash")).withColumn("key", F.lit(1))
    got = forest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    half = round(0.5**0.5, 9)
    assert by[0] == [(1, 1.0), (2, 1.0), (3, 1.0), (50, half), (51, half)]
    assert by[50] == [(51, 1.0), (0, half), (1, half), (2, half), (3, half)]
    assert set(by) == {0, 50}  # 100 has no vector of its length beside it


def test_one_vector_shared_by_most_rows(spark):
    rows = [(i, [0.5, 0.5, 0.1] if i % 3 else [float(i), 1.0, 2.0], 0) for i in range(900)]
    found = result(forest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert found[50] == [1, 2, 4, 5, 7] and found[100] == [1, 2, 4, 5, 7]
    assert found == plain([r[:2] for r in rows], 5, range(0, 900, 50))


def test_an_id_with_several_vectors_and_an_empty_table(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [1.0, 0.1], 0), (2, [0.2, 1.0], 0), (2, [-1.0, -1.0], 0)]
    got = forest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    empty = forest.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert empty.count() == 0 and empty.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
