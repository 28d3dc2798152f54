"""Keyed state: the rules by hand, and streams shuffled over micro-batches and restarts against the replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltwork.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
LOG = "k string, event_id long, kind string, value string, ts timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def log(spark, rows):
    return spark.createDataFrame([(k, i, kind, v, at(s)) for i, (k, kind, v, s) in enumerate(rows)], LOG)


def outcomes(df):
    rows = sorted(df.collect(), key=lambda r: (r.k, r.ts, r.event_id is not None, r.event_id or 0))
    return [(r.k, r.event_id, r.outcome, r.started, None if r.due is None else (r.due - T0).total_seconds()) for r in rows]


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    J.use_keyed_state(spark)
    yield spark
    spark.conf.set(name, before)


def test_deliveries_by_hand(spark):
    rows = [
        ("a", "delivery", "h", 0), ("a", "delivery", "h", 1), ("a", "failed", None, 2), ("a", "delivery", "h", 3), ("a", "delivery", "h", 4), ("a", "delivery", "other", 5), ("a", "failed", None, 6), ("a", "delivery", "other", 7),
        ("a", "delivery", "h", 99), ("a", "delivery", "other", 100), ("a", "delivery", "h", 150), ("b", "failed", None, 1),
    ]
    got = [r[2] for r in outcomes(J.replay(log(spark, rows), J.Deliveries(100), "k"))]
    assert got == ["accepted", "duplicate", "failed", "retried", "duplicate", "conflict", "failed", "conflict", "retried", "accepted", "conflict", "unknown"]


def test_jobs_by_hand(spark):
    rows = [
        ("a", "done", None, 0), ("a", "push", "1", 1), ("a", "push", "2", 2), ("a", "push", "3", 3), ("a", "done", None, 4), ("a", "push", "3", 5), ("a", "done", None, 6), ("a", "push", "3", 7),
        ("a", "push", "4", 8), ("a", "failed", None, 9), ("a", "failed", None, 10), ("a", "push", "5", 11), ("a", "failed", None, 12), ("a", "done", None, 13), ("a", "push", "4", 14),
    ]
    got = [r[2:] for r in outcomes(J.replay(log(spark, rows), J.Jobs(attempts=3), "k"))]
    assert got == [
        ("idle", None, None), ("queued", "1", None), ("pending", None, None), ("pending", None, None), ("done", "3", None), ("pending", None, None), ("done", None, None), ("dropped", None, None),
        ("queued", "4", None), ("retrying", "4", 14.0), ("retrying", "4", 20.0), ("pending", None, None), ("failed", "5", None), ("done", None, None), ("queued", "4", None),
    ]
    with pytest.raises(ValueError):
        J.Jobs(attempts=0)


def test_leases(spark):
    rows = [("a", "push", "1", 0), ("a", "push", "2", 30), ("a", "push", "3", 500), ("b", "push", "1", 0), ("b", "done", None, 5), ("b", "push", "2", 900)]
    got = [r[:4] for r in outcomes(J.replay(log(spark, rows), J.Jobs(lease=100), "k", until="2024-01-01 00:15:50"))]
    assert got == [
        ("a", 0, "queued", "1"), ("a", 1, "pending", None), ("a", None, "stalled", "1"), ("a", None, "failed", "2"), ("a", None, "stalled", "2"), ("a", None, "failed", None), ("a", 2, "queued", "3"), ("a", None, "stalled", "3"), ("a", None, "failed", None),
        ("b", 3, "queued", "1"), ("b", 4, "done", None), ("b", 5, "queued", "2"),
    ]


def streamed(spark, folder, parts, rules, name, delay="2 hours"):
    """Writes the parts as files and runs the stream over each with a restart in between; returns what the sink holds."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = J.stateful(s, rules, "k", delay=delay).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None, k
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("name", ["jobs", "deliveries"])
def test_shuffled_stream_with_restarts_equals_replay(keyed, tmp_path, name):
    spark, rng = keyed, random.Random(8)
    kinds = ("push", "push", "done", "failed") if name == "jobs" else ("delivery", "delivery", "failed")
    rows = [(f"k{rng.randrange(4)}", rng.choice(kinds), str(rng.randrange(3)), 40 * i) for i in range(160)]
    rules = J.Jobs(attempts=2, lease=600) if name == "jobs" else J.Deliveries(1500)
    whole = log(spark, rows).withColumn("part", F.floor((F.unix_timestamp("ts") - F.lit(1704067200) + F.pmod(F.hash("event_id"), F.lit(40)) * 60) / 1500))  # out of order by up to 40 minutes
    parts = [whole.where(F.col("part") == p).drop("part") for p in sorted(r[0] for r in whole.select("part").distinct().collect())]
    end = spark.createDataFrame([("end", 10_000, kinds[0], "x", at(40 * 160 + 3 * 3600))], LOG)
    got = streamed(spark, str(tmp_path), [*parts[:2], parts[2].unionAll(parts[3]), *parts[4:], end], rules, name)
    want = J.replay(whole.drop("part").unionAll(end), rules, "k", until=at(40 * 160 + 3600))
    assert outcomes(got.where("k != 'end'")) == outcomes(want.where("k != 'end'")) and got.where("k != 'end'").count() >= 160


def test_state_ends_with_the_retention(keyed, tmp_path):
    """After the retention nothing of an id is left in the store."""
    spark = keyed
    parts = [log(spark, [("a", "delivery", "h", 0), ("b", "delivery", "h", 1)]), log(spark, [("c", "delivery", "h", 20_000)]), log(spark, [("c", "delivery", "h", 40_000)])]
    streamed(spark, str(tmp_path), parts, J.Deliveries(3600), "retention", delay="1 minute")
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state")
    assert {r["key"]["k"] for r in held.select("key").collect()} <= {"c"}


def test_pushes_with_jobs(spark, tmp_path):
    pushes = [(1, 10, at(100)), (2, 10, at(7000)), (3, 20, at(200)), (4, 10, at(90)), (5, 30, at(20_000))]
    jobs = [(10, "j1", at(50)), (20, "j2", at(300)), (10, "j3", at(95)), (30, "j4", at(20_000))]
    p = spark.createDataFrame(pushes, "event_id long, repository_id long, ts timestamp")
    j = spark.createDataFrame(jobs, "repository_id long, job_id string, started_at timestamp")
    want = {(1, "j1", "pending"), (1, "j3", "pending"), (4, "j1", "pending"), (2, None, "queued"), (3, None, "queued"), (5, "j4", "pending")}
    pick = lambda df: {(r.event_id, r.job_id, r.outcome) for r in df.collect()}
    assert pick(J.pushes_with_jobs(p, j)) == want
    for name, df, late in (("p", p, [(6, 10, at(101)), (7, 40, at(90_000))]), ("j", j, [(40, "j5", at(90_000))])):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        late = spark.createDataFrame(late, df.schema)
        late.coalesce(1).write.parquet(f"{tmp_path}/late-{name}")
    for step in range(2):
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        q = J.pushes_with_jobs(read("p", p.schema), read("j", j.schema)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        if not step:  # the first run's watermark makes event 6 late: it is dropped, as is its state
            for name in ("p", "j"):
                spark.read.parquet(f"{tmp_path}/late-{name}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    got = pick(spark.read.parquet(f"{tmp_path}/out"))
    assert got - {(7, "j5", "pending")} == want
