"""Streams through memory sinks with availableNow, against the replay of the same log."""

import json

import pytest
from pyspark.sql import functions as F

from siltwork.streaming import events as S

PUSH = {"ref": "refs/heads/main", "after": "a" * 40, "deleted": False, "repository": {"id": 7, "name": "r", "full_name": "O/R", "private": False, "default_branch": "main", "owner": {"login": "O"}}, "installation": {"id": 3}}


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_parse(spark):
    rows = [
        ("1", "push", json.dumps(PUSH)), ("2", "push", json.dumps(PUSH | {"ref": "refs/tags/v1"})), ("3", "push", json.dumps(PUSH | {"deleted": True})), ("4", "installation", json.dumps({"action": "deleted", "installation": {"id": 3}})),
        ("5", "installation_repositories", json.dumps({"action": "removed", "installation": {"id": 3}, "repositories_removed": [{"id": 1}, {"id": 1}]})), ("6", "star", "{}"), ("7", "push", "{"), ("8", "push", json.dumps(PUSH | {"after": "xyz"})),
    ]
    got = {r["delivery_id"]: r for r in S.parse(spark.createDataFrame(rows, "delivery_id string, event string, body string")).collect()}
    assert [got[k]["kind"] for k in "12345678"] == ["push", "ignored", "ignored", "installation_revoked", "repositories_revoked", "ignored", "invalid", "invalid"]
    assert got["1"]["branch"] == "main" and got["5"]["removed_ids"] == [1]


def test_push_outcomes_and_revocation(spark):
    repos = spark.createDataFrame([("x", 3, 7, "main", "o/r", "ready", "b", False), ("y", 3, 8, "main", "o/s", "indexing", "b", True)], "id string, installation_id long, github_repository_id long, branch string, full_name string, status string, last_indexed_commit string, has_live_job boolean")
    pushes = spark.createDataFrame([(3, 7, "main", "O/R", "c"), (3, 7, "main", "O/R", "b"), (3, 8, "main", "o/S", "c"), (3, 7, "dev", "O/R", "c")], "installation_id long, repository_id long, branch string, full_name string, commit_sha string")
    assert sorted((r["target"], r["commit_sha"], r["outcome"]) for r in S.push_outcomes(pushes, repos).collect()) == [("x", "b", "deduplicated"), ("x", "c", "queued"), ("y", "c", "deduplicated")]
    gone = spark.createDataFrame([("repositories_revoked", 3, [8])], "kind string, installation_id long, removed_ids array<long>")
    assert {r["id"]: r["status"] for r in S.revoke(repos, gone).collect()} == {"x": "ready", "y": "failed"}


@pytest.fixture
def log(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("user_id").alias("repository_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "done").otherwise("push").alias("kind"), (F.floor("value") % 5).cast("string").alias("commit_sha"))
    e.coalesce(1).write.parquet(str(tmp_path / "log"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "log"))


def test_stateful_coalesce(spark, log, tmp_path):
    batch, stream = log
    got = run(S.stateful_coalesce(stream), "coalesced", tmp_path)
    want = S.coalesce_pushes(batch).where("kind != 'done'")
    key = ["repository_id", "commit_sha", "outcome"]
    assert sorted(map(tuple, got.groupBy(*key).count().collect())) == sorted(map(tuple, want.groupBy(*key).count().collect()))


def test_stateful_dedup(spark, log, tmp_path):
    batch, stream = log
    s = stream.select(F.col("repository_id").cast("string").alias("delivery_id"), F.col("commit_sha").alias("payload_hash"), "ts")
    got = run(S.stateful_outcomes(s), "outcomes", tmp_path)
    want = S.delivery_outcomes(batch.withColumn("payload_hash", F.col("commit_sha")), key="repository_id")
    assert sorted(map(tuple, got.groupBy("outcome").count().collect())) == sorted(map(tuple, want.groupBy("outcome").count().collect()))
    once = run(S.first_deliveries(s), "once", tmp_path)
    assert once.count() == batch.select("repository_id").distinct().count()


def test_windowed_stream(spark, log, tmp_path):
    batch, stream = log
    got = run(S.rate_windows(stream.withWatermark("ts", "1 hour"), key="repository_id", limit=1), "rates", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.rate_windows(batch, key="repository_id", limit=1).collect()))


def test_dispatch(spark, log, tmp_path):
    _, stream = log
    seen = []
    S.dispatch(stream, {"push": lambda d, e: seen.append(d.count()), "done": lambda d, e: seen.append(d.count())}, str(tmp_path / "dispatch")).awaitTermination(120)
    assert sum(seen) == log[0].count()


def test_superseding():
    commits = iter(["a", "b", None])
    ran = []
    assert S.superseding(ran.append, lambda c: next(commits)) == "done" and ran == ["a", "b"]
    with pytest.raises(RuntimeError):
        S.superseding(ran.append, lambda c: "x")
