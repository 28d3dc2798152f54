"""The inverted file against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.operators import ivf

POINTS = "vec_id long, embedding array<double>"


def exact(rows, k):
    ids, x = np.array([i for i, _ in rows]), ivf._units([v for _, v in rows])
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -score[i].round(12)))[:k]] for i in range(len(ids))}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(ivf, "PART", 40)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 8))[rng.integers(0, 12, 500)] + spread * rng.standard_normal((500, 8))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, POINTS).repartition(4)
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert found(ivf.nearest(df, q, 4, probes=1)) == exact(rows, 4)


def test_few_points_ties_and_zeros(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, POINTS)
    q = spark.createDataFrame([(2, [1.0, 0.0]), (9, [0.0, 1.0]), (4, [0.0, 0.0])], "query_id long, query array<double>")
    got = found(ivf.nearest(df, q, 5))
    assert got[2] == [1, 3, 4] and got[9] == [1, 2, 3, 4] and got[4] == [1, 2, 3]
    assert ivf.nearest(df.limit(0), q, 2).count() == 0 and ivf.nearest(df, q.limit(0), 2).count() == 0


def test_copies_tie_by_key_and_no_vector_is_sent_for_each_list(spark, monkeypatch):
    """Most of the rows are copies of three vectors, in blocks of 16; the widest shuffle holds each row once."""
    monkeypatch.setattr(ivf, "PART", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 7))
    x[60:] = x[rng.integers(0, 3, 240)]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    got = ivf.nearest(df, df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)
    assert found(got) == exact(rows, 3)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan
    for batch in (ivf._units(x), ivf._units(x)[::-1]):  # of one block, all copies but the first k + 1
        keys = np.arange(len(batch))
        kept = ivf._few_copies(keys, batch, 3)
        assert len(kept) < 80 and all(np.sum((batch == batch[i]).all(1) & (keys < i)) <= 3 for i in kept)


def test_memory_does_not_grow_with_centres_or_precision(spark, monkeypatch):
    """Angles to the centres are taken for a bounded number of rows; single-precision vectors stay so until they are compared."""
    rng = np.random.default_rng(5)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.standard_normal((700, 6)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    seen, kept, angles, frame = [], [], ivf._angles, type(df)
    with monkeypatch.context() as m:
        m.setattr(ivf, "PART", 100)
        m.setattr(ivf, "_angles", lambda x, c: (seen.append(len(x)), angles(x, c))[1])
        centres = ivf.fit(df)
    assert max(seen) <= 100 and len(centres) == 27
    double = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    with monkeypatch.context() as m:
        m.setattr(frame, "checkpoint", lambda self, f=frame.checkpoint: (kept.append(self.schema["vector"].dataType.simpleString() if "vector" in self.columns else ""), f(self))[1])
        got = [found(ivf.nearest(df, q, 4, probes=2, centres=centres)) for q in (double, double.withColumn("query", F.col("query").cast("array<float>")))]
    assert got == [exact(rows, 4)] * 2
    assert [x for x in kept if x] == ["array<float>", "array<double>", "array<float>", "array<float>"]


def test_near_copies_and_one_listing_of_points_that_ask(spark, monkeypatch):
    """Groups whose scores differ by less than single precision tells, in several blocks and slices; points that are the queries
    as well get their lists once."""
    monkeypatch.setattr(ivf, "PART", 128)
    monkeypatch.setattr(ivf, "SLICE", 24)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4, 8))[np.arange(600) % 5 % 4] + 5e-4 * rng.standard_normal((600, 8))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df, kept, frame = spark.createDataFrame(rows, POINTS).repartition(3), [], type(spark.range(1))
    with monkeypatch.context() as m:
        m.setattr(frame, "checkpoint", lambda self, f=frame.checkpoint: (kept.append("vector" in self.columns), f(self))[1])
        got = ivf.neighbour_graph(df, 4).orderBy("source", F.desc("score"), "target").collect()
    assert sum(kept) == 1
    u = ivf._units(x)
    score = np.array([np.einsum("ij,ij->i", np.broadcast_to(v, u.shape), u) for v in u])
    np.fill_diagonal(score, -np.inf)
    assert [(r.source, r.target) for r in got] == [(i, j) for i in range(600) for j in np.lexsort((np.arange(600), -score[i]))[:4]]
    # Of loose bounds and tight ones, no pair that counts is left out, and no row is ranked whole.
    u = ivf._units(x[::3])
    s, f4 = u @ u.T, u.astype("f4")
    for least in (np.full(200, -np.inf), np.sort(s, 1)[:, -4]):
        hit = ivf._among(f4 @ f4.T, least, 24 * 2.0**-24, 4)
        assert (hit | (s < np.sort(s, 1)[:, -4:-3])).all()
    loose = rng.standard_normal((64, 4096)).astype("f4")
    assert ivf._among(loose, np.full(64, -np.inf), 1e-6, 3).sum() < 64 * 40
