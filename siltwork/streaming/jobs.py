"""Deliveries and index jobs as keyed state: one set of rules for a stream and for the replay of a bounded log.

A rule set takes a key's events in order of their time and event id. :func:`replay` runs it over sorted partitions of a
log. :func:`stateful` runs it on a stream that may be out of order by the watermark's delay: a processor keeps events that
wait for the watermark, the rules' own state, and timers for both and for deadlines (leases, retention). So a stream
has the replay's outcomes however its events were shuffled within the delay, and after a restart. It needs the state
store of :func:`use_keyed_state`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_SECOND = 1_000_000
_EVENT = "at long, event_id long, kind string, value string"
OUTCOMES = "event_id long, ts timestamp, outcome string, started string, due timestamp"


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that processors with several state variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Event(NamedTuple):
    at: int  # microseconds
    event_id: int | None
    kind: str
    value: str | None


class Outcome(NamedTuple):
    event_id: int | None
    at: int
    outcome: str
    started: str | None = None
    due: int | None = None


class Deliveries:
    """Deliveries (kind ``delivery``, value: the payload's hash) and failures of their jobs (``failed``), by delivery id:
    accepted, duplicate (the same payload), retried (after a failure), conflict (another payload), failed, or unknown (a
    failure of what was not accepted). An id is forgotten when the retention since its acceptance has passed."""

    state = "digest string, since long, failed boolean"

    def __init__(self, retention_seconds: float = 30 * 24 * 3600) -> None:
        self.retention = int(retention_seconds * _SECOND)

    def deadline(self, s: tuple | None) -> int | None:
        return s[1] + self.retention if s else None

    def expire(self, s: tuple) -> tuple[tuple | None, list[Outcome]]:
        return None, []

    def step(self, s: tuple | None, e: Event) -> tuple[tuple | None, str, str | None, int | None]:
        if e.kind == "failed":
            return ((s[0], s[1], True), "failed", None, None) if s else (None, "unknown", None, None)
        if not s:
            return (e.value, e.at, False), "accepted", None, None
        if s[0] != e.value:
            return s, "conflict", None, None
        return (s[0], s[1], False), "retried" if s[2] else "duplicate", None, None


class Jobs:
    """Pushes (kind ``push``, value: the commit), completions (``done``) and failed attempts (``failed``) of a repository.

    A push is queued if no job is live, dropped if its commit is the last indexed one, else pending: the newest pending
    commit is queued when the live job ends, unless it is what the job indexed. A failed attempt is retried after
    ``backoff`` seconds, doubled each time, up to ``attempts``; then the job has failed. A job without news for ``lease``
    seconds has stalled: it starts again once, and fails the second time. ``started`` is the commit of which a job (or an
    attempt) starts with the event. An event for which no job is live is idle."""

    state = "live string, indexed string, pending string, attempt int, stalls int, deadline long"

    def __init__(self, attempts: int = 5, backoff: float = 5.0, lease: float | None = None) -> None:
        if not 1 <= attempts <= 10:
            raise ValueError("attempts must be between 1 and 10")
        self.attempts, self.backoff, self.lease = attempts, int(backoff * _SECOND), None if lease is None else int(lease * _SECOND)

    def deadline(self, s: tuple | None) -> int | None:
        return s[5] if s else None

    def _starts(self, commit: str | None, indexed: str | None, at: int) -> tuple:
        return (commit, indexed, None, 1, 0, at + self.lease if self.lease is not None and commit is not None else None)

    def _ends(self, s: tuple, indexed: str | None, at: int) -> tuple:
        return self._starts(s[2] if s[2] != s[0] else None, indexed, at)

    def expire(self, s: tuple) -> tuple[tuple | None, list[Outcome]]:
        live, indexed, pending, attempt, stalls, at = s
        if stalls == 0:
            return (live, indexed, pending, attempt, 1, at + self.lease), [Outcome(None, at, "stalled", live)]
        after = self._ends(s, indexed, at)
        return after, [Outcome(None, at, "failed", after[0])]

    def step(self, s: tuple | None, e: Event) -> tuple[tuple | None, str, str | None, int | None]:
        live, indexed, pending, attempt, stalls, until = s or (None, None, None, 1, 0, None)
        if e.kind == "push":
            if live is not None:
                return (live, indexed, e.value, attempt, stalls, until), "pending", None, None
            if indexed is not None and indexed == e.value:
                return s, "dropped", None, None
            return self._starts(e.value, indexed, e.at), "queued", e.value, None
        if live is None:
            return s, "idle", None, None
        if e.kind == "failed" and attempt < self.attempts:
            due = e.at + self.backoff * 2 ** (attempt - 1)
            return (live, indexed, pending, attempt + 1, 0, due + self.lease if self.lease is not None else None), "retrying", live, due
        after = self._ends(s, live if e.kind == "done" else indexed, e.at)
        return after, "done" if e.kind == "done" else "failed", after[0], None


def _until(rules, s: tuple | None, now: int | None) -> tuple[tuple | None, list[Outcome]]:
    """The state after all deadlines up to ``now``."""
    out: list[Outcome] = []
    while now is not None and (at := rules.deadline(s)) is not None and at <= now:
        s, more = rules.expire(s)
        out += more
    return s, out


def _run(rules, s: tuple | None, events: list[Event], now: int | None = None) -> tuple[tuple | None, list[Outcome]]:
    out: list[Outcome] = []
    for e in events:
        s, timed = _until(rules, s, e.at)
        s, outcome, started, due = rules.step(s, e)
        out += [*timed, Outcome(e.event_id, e.at, outcome, started, due)]
    s, timed = _until(rules, s, now)
    return s, out + timed


def _frame(key: str, keys: list, outcomes: list[Outcome]) -> pd.DataFrame:
    time = lambda v: pd.to_datetime(pd.array(v, "Int64"), unit="us")
    return pd.DataFrame({
        key: keys, "event_id": pd.array([o.event_id for o in outcomes], "Int64"), "ts": time([o.at for o in outcomes]),
        "outcome": [o.outcome for o in outcomes], "started": [o.started for o in outcomes], "due": time([o.due for o in outcomes]),
    })


def _source(log: DataFrame, key: str, at: str, tie: str, kind: str, value: str) -> DataFrame:
    return log.select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("event_id"), F.col(kind).alias("kind"), F.col(value).cast("string").alias("value"))


def replay(log: DataFrame, rules, key: str, at: str = "ts", tie: str = "event_id", kind: str = "kind", value: str = "value", until=None) -> DataFrame:
    """key, event_id, ts, outcome, started, due: one row per event, and those of deadlines (without an event id) up to the
    key's last event or ``until``. Sorted partitions are streamed; the state of one key is held."""
    src, end = _source(log, key, at, tie, kind, value), None if until is None else pd.Timestamp(until, tz="UTC").value // 1000
    kind_of = dict(src.dtypes)["k"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, begun = None, None, False
        for p in parts:
            keys: list = []
            out: list[Outcome] = []

            def close(s=None):
                timed = _until(rules, s, end)[1] if begun else []
                keys.extend([now] * len(timed))  # noqa: B023
                out.extend(timed)  # noqa: B023

            p = p.astype({"event_id": "Int64"}).astype(object).where(p.notna(), None)
            for k, *event in p[["k", "at", "event_id", "kind", "value"]].itertuples(index=False):
                if not begun or k != now:
                    close(s)
                    now, s, begun = k, None, True
                s, more = _run(rules, s, [Event(*event)])
                keys += [k] * len(more)
                out += more
            yield _frame(key, keys, out)
        if begun:
            timed = _until(rules, s, end)[1]
            if timed:
                yield _frame(key, [now] * len(timed), timed)

    return src.drop("ts").where("at is not null").repartition("k").sortWithinPartitions("k", "at", "event_id").mapInPandas(run, f"`{key}` {kind_of}, {OUTCOMES}")


class _Ordered(StatefulProcessor):
    """Applies rules to a key's events once the watermark has passed them."""

    def __init__(self, rules, key: str) -> None:
        self.rules, self.key = rules, key

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.held = handle.getValueState("held", self.rules.state)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            events = frame[["at", "event_id", "kind", "value"]].astype(object).where(frame[["at", "event_id", "kind", "value"]].notna(), None)
            self.waiting.appendList([tuple(e) for e in events.itertuples(index=False)])
            for at in set(frame["at"]):
                self.handle.registerTimer(int(at) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = [Event(*e) for e in (self.waiting.get() if self.waiting.exists() else [])]
        ready = sorted((e for e in events if e.at < now), key=lambda e: (e.at, e.event_id is not None, e.event_id or 0))
        left = [tuple(e) for e in events if e.at >= now]
        if left:
            self.waiting.put(left)
        elif events:
            self.waiting.clear()
        before = tuple(self.held.get()) if self.held.exists() else None
        s, out = _run(self.rules, before, ready, now)
        if s is None:
            self.held.clear()
        elif s != before:
            self.held.update(s)
            if (at := self.rules.deadline(s)) is not None and at >= now:
                self.handle.registerTimer(at // 1000 + 1)
        if out:
            yield _frame(self.key, [key[0]] * len(out), out)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, rules, key: str, at: str = "ts", tie: str = "event_id", kind: str = "kind", value: str = "value", delay: str = "1 hour") -> DataFrame:
    """The same rows on a stream, each when the watermark (``delay`` behind the latest event) has passed it."""
    src = _source(stream, key, at, tie, kind, value)
    kind_of = dict(src.dtypes)["k"]
    return src.withWatermark("ts", delay).groupBy("k").transformWithStateInPandas(_Ordered(rules, key), f"`{key}` {kind_of}, {OUTCOMES}", "Append", "eventtime")


# -- pushes and jobs of two streams --


def pushes_with_jobs(pushes: DataFrame, jobs: DataFrame, key: str = "repository_id", lease: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each push with the job that was live at its time: of jobs(repository, job_id, started_at) that started at most ``lease`` before it,
    or nulls. On streams an outer join with watermarks on both sides: a push without a partner comes out when the
    watermark shows that none can follow, and state older than the lease is gone."""
    streaming = pushes.isStreaming
    p = pushes.withWatermark("ts", delay) if streaming else pushes
    j = jobs.select(F.col(key).alias("job_key"), "job_id", "started_at")
    j = j.withWatermark("started_at", delay) if streaming else j
    span = F.expr(f"INTERVAL {lease}")
    on = (F.col(key) == F.col("job_key")) & (F.col("started_at") <= F.col("ts")) & (F.col("started_at") > F.col("ts") - span)
    return p.join(j, on, "left_outer").drop("job_key").withColumn("outcome", F.when(F.col("job_id").isNull(), "queued").otherwise("pending"))
