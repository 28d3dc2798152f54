"""Validation of recordings, settings and points, and timeouts of live runs."""

import time

import pytest

from siltwork.operators import evaluation, vectors
from siltwork.streaming import events


def test_observations(spark):
    good = {"answer": "a", "retrieved_sources": [("1", "src/a.ts", None, 1, 2, 0.5)], "citations": [("src/a.ts", None, 1, 1)], "timings": (1.0, 2.0, None), "usage": (1, None, 3), "metadata": None}
    bad = {
        "answer": {"answer": " "}, "source": {"retrieved_sources": [("1", "/abs", None, 1, 2, 0.5)]}, "citation": {"citations": [("src/a.ts", None, 3, 2)]}, "timings": {"timings": (-1.0, 2.0, None)},
        "usage": {"usage": (-1, None, 3)}, "sources": {"retrieved_sources": good["retrieved_sources"] * (evaluation.MAX_SOURCES + 1)},
    }
    rows = [("ok", good), *[(k, good | v) for k, v in bad.items()], ("twice", good), ("twice", good), ("missing times", good | {"timings": None}), ("score", good | {"retrieved_sources": [("1", "a", None, 1, 2, float("nan"))]})]
    df = spark.createDataFrame([(i, *[o[k] for k in good]) for i, o in rows], evaluation.OBSERVATION)
    got = {(r["case"], r["problem"]) for r in evaluation.observation_problems(df).collect()}
    assert got == {(k, k) for k in bad} | {("twice", "repeated id"), ("missing times", "timings"), ("score", "source")}


def test_settings():
    assert evaluation.setting_problems({"minimumRecallAt5": 0.8, "maximumRetrievalP95Ms": 2000}, {"input": 3}) == []
    assert evaluation.setting_problems({"minimumRecallAt5": 1.5, "other": 1, "maximumTotalCostUsd": -1, "minimumRecallAt10": True}, {"output": float("inf"), "x": 1}) == ["minimumRecallAt5", "other", "maximumTotalCostUsd", "minimumRecallAt10", "output", "x"]


def test_live_cases_time_out_and_keep_their_order(spark):
    def target(case, question):
        if case == "slow":
            time.sleep(30)
        if case == "bad":
            raise KeyError(question)
        return {"answer": question}

    cases = spark.createDataFrame([("z", "q1", 0), ("slow", "q2", 1), ("bad", "q3", 2), ("a", "q4", 3)], "id string, question string, at int")
    began = time.time()
    got = [(r["case_id"], r["observation"], r["error"]) for r in evaluation.run_live(cases, target, 2, timeout=1.0, order="at").collect()]
    assert got == [("z", '{"answer": "q1"}', None), ("slow", None, "TimeoutError"), ("bad", None, "KeyError"), ("a", '{"answer": "q4"}', None)]
    assert time.time() - began < 25
    with pytest.raises(ValueError):
        evaluation.run_live(cases, target, 17)


def test_points_of_one_batch(spark):
    ok = ("0f8fad5b-d9cb-4c69-8a65-70867728950e", "u", "text", 1, 2, "a" * 64, [1.0, 2.0])
    other = "1f8fad5b-d9cb-4c69-8a65-70867728950e"
    rows = [ok, ok, (other, " u", *ok[2:]), ("2" + other[1:], "u\0", *ok[2:]), ("3" + other[1:], *ok[1:])]
    df = spark.createDataFrame(rows, "id string, user_id string, content string, start_line int, end_line int, content_hash string, embedding array<double>")
    got = sorted((r["id"][0], r["error"]) for r in vectors.valid_points(df, 2, ("user_id",)).collect() if r["error"])
    assert got == [("0", "repeated id"), ("0", "repeated id"), ("1", "user_id"), ("2", "user_id")]
    assert vectors.valid_points(df, 2).where("error IS NOT NULL").count() == 0


def test_outcome_counts(spark):
    df = spark.createDataFrame([("a", "queued"), ("a", "queued"), ("b", "dropped")], "repository string, outcome string")
    assert {tuple(r) for r in events.outcome_counts(df).collect()} == {("queued", 2), ("dropped", 1)}
    assert {tuple(r) for r in events.outcome_counts(df, ["repository"]).collect()} == {("a", "queued", 2), ("b", "dropped", 1)}
