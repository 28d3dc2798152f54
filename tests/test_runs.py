"""Listings by tasks, cancelled runs, observed streams, requests to a provider."""

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.functions.checks import BoundExceeded, InvalidRows
from siltwork.operators import vectors
from siltwork.sources import listing, manifest
from siltwork.streaming import runs


def test_tree(spark, tmp_path):
    for p in ("a.ts", ".hidden/x", "src/b.ts", "src/deep/c.ts", "src/deep/er/d.ts", "_u", "node_modules/z.ts", "big"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / "big").write_bytes(b"x" * 2000)
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    os.symlink(tmp_path / "src", tmp_path / "loop")
    df = listing.tree(spark, str(tmp_path), prune="node_modules", max_bytes=1000)
    got = {r["path"]: (r["name"], r["depth"], r["size"], r["content"]) for r in df.collect()}
    assert set(got) == {"a.ts", ".hidden/x", "src/b.ts", "src/deep/c.ts", "src/deep/er/d.ts", "_u", "big"}
    assert got["src/deep/c.ts"] == ("c.ts", 2, 13, bytearray(b"src/deep/c.ts")) and got["big"][3] is None
    assert df.rdd.getNumPartitions() > 2  # each folder of the upper levels is a task's
    for option in ({"max_entries": 1}, {"max_depth": 1}):
        with pytest.raises(Exception, match="BoundExceeded"):
            listing.tree(spark, str(tmp_path), **option).collect()
    with pytest.raises(Exception, match="NotADirectory"):
        listing.tree(spark, str(tmp_path / "loop")).collect()


def test_pages(spark):
    def fetch(source, page):
        if source == "b":
            return [{"id": 7, "name": "x"}, {"id": "no", "name": "y"}, "odd", {"id": 8, "name": None}] if page == 1 else []
        return [{"id": page * 10 + k, "name": source} for k in range(3 if page < 4 else 1)]

    got = sorted(map(tuple, listing.paged(spark, ["a", "b"], fetch, "id long, name string", F.col("name").isNotNull(), page_size=3).collect()))
    assert got == [("a", i, "a") for i in (10, 11, 12, 20, 21, 22, 30, 31, 32, 40)] + [("b", 7, "x")]
    with pytest.raises(Exception, match="BoundExceeded"):
        listing.paged(spark, ["a"], fetch, "id long", page_size=3, most_pages=2).collect()
    with pytest.raises(BoundExceeded):
        listing.paged(spark, ["a"] * 21, fetch, "id long")


@pytest.fixture
def store(spark, tmp_path):
    return manifest.Store(spark, f"file://{tmp_path}/store")


def test_a_run_reports_and_commits(spark, store):
    run = runs.Run(store, "j")
    for step in ("cloning", "scanning", "storing"):
        with run.stage(step) as writes:
            if step == "storing":
                writes.replace("points", spark.range(5))
    run.commit()
    assert store.read("points").count() == 5
    assert [(r["kind"], r["progress"]) for r in store.log().orderBy("version").collect()] == [("begin", 0.0), ("progress", 5.0), ("progress", 20.0), ("progress", 85.0), ("commit", 100.0)]
    run = runs.Run(store, "k")
    with pytest.raises(ZeroDivisionError), run.stage("cloning"):
        1 / 0  # noqa: B018
    assert store.log().orderBy(F.desc("version")).first()["error"] == "ZeroDivisionError" and not store.live("k")


def test_a_cancelled_run_leaves_no_version_and_stops_its_jobs(spark, store):
    run = runs.Run(store, "j")
    with run.stage("cloning") as writes:
        writes.replace("points", spark.range(3))

    def slow(parts):
        for p in parts:
            time.sleep(60)
            yield p

    began = time.time()
    threading.Timer(3, lambda: runs.cancel(store, "j")).start()
    with pytest.raises(manifest.Cancelled), run.stage("chunking") as writes:
        writes.replace("chunks", spark.range(3).mapInPandas(slow, "id long"))
    assert time.time() - began < 40
    for late in (run.commit, lambda: run.stage("storing").__enter__()):
        with pytest.raises(manifest.Cancelled):
            late()
    assert store.tables() == {} and store.log().where("kind = 'cancelled'").count() == 1


def test_observers_of_streams_never_stop_them(spark, tmp_path):
    spark.range(20).selectExpr("id", "timestamp_seconds(id + 1000) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []

    def observe(row):
        seen.append(row)
        raise RuntimeError("an observer's own fault")

    listener = runs.Progress(observe)
    spark.streams.addListener(listener)
    try:
        s = spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "1 second").dropDuplicates(["id"])
        q = s.writeStream.format("memory").queryName("observed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if any(r["event"] == "ended" for r in seen):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert spark.table("observed").count() == 20
    assert {"started", "progress", "ended"} <= {r["event"] for r in seen} and sum(r.get("input_rows", 0) for r in seen) == 20


def test_requests(spark):
    texts = [f"text number {i % 40} " + "w " * (i % 7) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    provider = lambda t: {"vectors": vectors.hashing_embedder(t, 8), "model": "m", "tokens": sum(len(x.split()) for x in t)}
    counter = lambda t: [len(x.split()) for x in t]
    got = vectors.embed_requests(df, provider, counter, 8, most=6, budget=30)
    usage, total = got["usage"].collect(), got["totals"].first()
    distinct = set(texts)
    assert all(r["inputs"] <= 6 and r["tokens"] <= 30 for r in usage) and sum(r["inputs"] for r in usage) == len(distinct) == total["inputs"]
    assert (total["requests"], total["tokens"], total["model"]) == (len(usage), sum(len(t.split()) for t in distinct), "m")
    for r in got["points"].collect():
        assert np.allclose(r["embedding"], vectors.hashing_embedder([texts[r["id"]]], 8)[0])
    assert got["points"].count() == 120
    models = lambda t: provider(t) | {"model": t[0]}
    with pytest.raises(InvalidRows):
        vectors.embed_requests(df, models, counter, 8, most=6, budget=30)
    for bad in (spark.createDataFrame([(1, " ")], df.schema), spark.createDataFrame([(1, "w " * 31)], df.schema)):
        with pytest.raises(Exception, match="blank|budget"):
            vectors.embed_requests(bad, provider, counter, 8, most=6, budget=30)


def test_token_counter_is_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    assert vectors.token_counter(public.path("byte_bpe_50k.json"))(["Hello world", "", "<|endoftext|>"]) == [2, 0, 7]


def test_results_are_checked(spark):
    ok = ("0f8fad5b-d9cb-4c69-8a65-70867728950e", 0.5, "r", 1, 2, "a" * 64)
    schema = "id string, score double, repository_id string, start_line int, end_line int, content_hash string"
    bad = [("x", *ok[1:]), (ok[0], float("nan"), *ok[2:]), (*ok[:2], "other", *ok[3:]), (*ok[:3], 3, 2, ok[5]), (*ok[:5], "A" * 64), (ok[0], None, *ok[2:])]
    got = [r["error"] for r in vectors.valid_results(spark.createDataFrame([ok, *bad], schema), repository_id="r").collect()]
    assert got == [None, "id", "score", "repository_id", "lines", "hash", "score"]
    assert vectors.checked_results(spark.createDataFrame([ok], schema), repository_id="r").count() == 1
    with pytest.raises(Exception, match="invalid search result"):
        vectors.checked_results(spark.createDataFrame([ok, bad[0]], schema), repository_id="r").count()
