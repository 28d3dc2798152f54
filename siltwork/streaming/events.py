"""Event streams: typed webhook events, deduplication, coalescing, revocation, windowed monitoring.

Functions on DataFrames work on batches and, where nothing else is said, on streams; replay functions give the
result of a stream's stateful operator over a bounded log, by windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import text as X

# Upper bounds of the duration histograms, in seconds.
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30]
DEPENDENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 120]
RETENTION = "30 days"
RATE_WINDOW, RATE_LIMIT = "15 minutes", 100
CYCLES = 3

PAYLOAD = (
    "struct<action:string,ref:string,after:string,deleted:boolean,repository:struct<id:long,name:string,full_name:string,private:boolean,default_branch:string,owner:struct<login:string>>,"
    "installation:struct<id:long>,repositories_removed:array<struct<id:long>>>"
)


def parse(deliveries: DataFrame) -> DataFrame:
    """delivery_id, payload_hash, kind, reason and the event's fields of deliveries(delivery_id, event, body). kind: push,
    installation_revoked, repositories_revoked, ignored or invalid; what is ignored stays in the output with its reason."""
    d = deliveries.withColumn("p", F.from_json("body", PAYLOAD)).withColumn("payload_hash", X.sha256("body"))
    p = lambda f: F.col(f"p.{f}")
    branch = F.nullif(F.regexp_extract(p("ref"), "^refs/heads/(.+)$", 1), F.lit(""))
    zero = p("after").rlike("^0+$")
    reason = F.when(F.get_json_object("body", "$").isNull(), "malformed").when(
        F.col("event") == "push", F.when(branch.isNull(), "not a branch").when(F.coalesce(p("deleted"), F.lit(False)) | zero, "deleted").when(p("installation.id").isNull() | p("repository.id").isNull() | ~F.coalesce(p("after").rlike("^[0-9a-f]{40,64}$"), F.lit(False)), "malformed"),
    ).when(F.col("event") == "installation", F.when(~F.coalesce(p("action").isin("deleted", "suspend"), F.lit(False)), "other action")).when(
        F.col("event") == "installation_repositories", F.when(F.coalesce(p("action"), F.lit("")) != "removed", "other action").when(F.coalesce(F.size(p("repositories_removed")), F.lit(0)) == 0, "nothing removed"),
    ).otherwise("other event")
    kind = F.when(reason == "malformed", "invalid").when(reason.isNotNull(), "ignored").when(F.col("event") == "push", "push").when(F.col("event") == "installation", "installation_revoked").otherwise("repositories_revoked")
    removed = F.array_distinct(F.transform(p("repositories_removed"), lambda r: r["id"]))
    return d.select(
        *[c for c in d.columns if c not in ("p", "body", "payload_hash")], "payload_hash", kind.alias("kind"), reason.alias("reason"), branch.alias("branch"), p("after").alias("commit_sha"),
        p("installation.id").alias("installation_id"), p("repository.id").alias("repository_id"), p("repository.full_name").alias("full_name"), removed.alias("removed_ids"),
    )


# -- deduplication --


def first_deliveries(stream: DataFrame, key: str = "delivery_id", at: str = "ts") -> DataFrame:
    """A stream with each delivery once within the retention."""
    return stream.withWatermark(at, RETENTION).dropDuplicatesWithinWatermark([key])


def delivery_outcomes(log: DataFrame, key: str = "delivery_id", at: str = "ts", digest: str = "payload_hash", tie: str = "event_id", failed: Column | None = None) -> DataFrame:
    """Adds ``outcome`` to a bounded log: accepted, duplicate (the same payload), retried (after a failure), conflict (another payload)."""
    w = W.partitionBy(key).orderBy(at, tie)
    before = F.first(digest).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    n = F.row_number().over(w)
    again = F.coalesce(F.lag(F.lit(False) if failed is None else failed).over(w), F.lit(False))
    return log.withColumn("outcome", F.when(n == 1, "accepted").when(before != F.col(digest), "conflict").when(again, "retried").otherwise("duplicate"))


def stateful_outcomes(stream: DataFrame, key: str = "delivery_id") -> DataFrame:
    """The same outcomes on a stream(delivery_id, payload_hash, ts): the hash of each delivery is state that ends with the retention."""
    out, state = "delivery_id string, outcome string", "payload_hash string"

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        known = held.get[0] if held.exists else None
        for f in frames:
            rows = []
            for digest in f.sort_values("ts", kind="stable")["payload_hash"]:
                rows.append((k[0], "accepted" if known is None else "duplicate" if known == digest else "conflict"))
                known = digest if known is None else known
            yield pd.DataFrame(rows, columns=["delivery_id", "outcome"])
        held.update((known,))
        held.setTimeoutDuration(30 * 24 * 3600 * 1000)

    return stream.select("delivery_id", "payload_hash", "ts").groupBy(key).applyInPandasWithState(step, out, state, "append", "ProcessingTimeTimeout")


# -- coalescing --


def push_outcomes(pushes: DataFrame, repositories: DataFrame) -> DataFrame:
    """outcome of each push(installation_id, repository_id, branch, full_name, commit_sha) for the repositories it means:
    deduplicated (ready at that commit, or a live job will see it), or queued. Works stream-static."""
    r = repositories.select(F.col("installation_id").alias("r_i"), F.col("github_repository_id").alias("r_r"), F.col("branch").alias("r_b"), F.col("full_name").alias("r_name"), F.col("id").alias("target"), "status", "last_indexed_commit", "has_live_job")
    j = pushes.join(r, (F.col("installation_id") == F.col("r_i")) & (F.col("repository_id") == F.col("r_r")) & (F.col("branch") == F.col("r_b")) & (F.lower("full_name") == F.lower("r_name")))
    same = (F.col("status") == "ready") & F.coalesce(F.col("last_indexed_commit") == F.col("commit_sha"), F.lit(False))
    busy = F.col("status").isin("queued", "cloning", "indexing") & F.col("has_live_job")
    return j.select("target", "commit_sha", F.when(same | busy, "deduplicated").otherwise("queued").alias("outcome"), F.when(same, F.lit(None)).otherwise(F.col("commit_sha")).alias("pending_commit"))


def coalesce_pushes(log: DataFrame, key: str = "repository_id", at: str = "ts", tie: str = "event_id", commit: str = "commit_sha") -> DataFrame:
    """Adds ``outcome`` to a bounded log of pushes and completions (kind = 'push' or 'done'): a push is queued if no job is
    live, pending if one is, dropped if its commit is the last indexed one. A job runs from its queued push to the next completion."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, live, indexed = None, None, None
        for df in parts:  # rows of a key stand together in order, so only its state is held
            out = []
            for k, kind, c in zip(df[key], df["kind"], df[commit], strict=True):
                if k != now:
                    now, live, indexed = k, None, None
                if kind == "done":
                    indexed, live = (live if live is not None else indexed), None
                    out.append("done")
                elif live is not None:
                    out.append("pending")
                elif indexed == c:
                    out.append("dropped")
                else:
                    live = c
                    out.append("queued")
            yield df.assign(outcome=out)

    return log.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(run, f"{schema}, outcome string")


def stateful_coalesce(stream: DataFrame) -> DataFrame:
    """The same on a stream(repository_id, kind, commit_sha, ts), with a repository's live, indexed and pending commit as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        live, indexed, pending = held.get if held.exists else (None, None, None)
        for f in frames:
            rows = []
            for kind, c in f.sort_values("ts", kind="stable")[["kind", "commit_sha"]].itertuples(index=False):
                if kind == "done":
                    if live is not None:
                        indexed, live, pending = live, None, None
                    continue
                if live is None and indexed == c:
                    rows.append((k[0], c, "dropped"))
                elif live is None:
                    live = c
                    rows.append((k[0], c, "queued"))
                else:
                    pending = c
                    rows.append((k[0], c, "pending"))
            yield pd.DataFrame(rows, columns=["repository_id", "commit_sha", "outcome"])
        held.update((live, indexed, pending))

    return stream.select("repository_id", "kind", "commit_sha", "ts").groupBy("repository_id").applyInPandasWithState(
        step, "repository_id long, commit_sha string, outcome string", "live string, indexed string, pending string", "append", "NoTimeout"
    )


def superseding(run, pending, cycles: int = CYCLES) -> str:
    """Runs a job again while a newer commit came up meanwhile: run(commit) indexes, pending(commit) is the newer commit or None."""
    commit = pending(None)
    for _ in range(cycles):
        if commit is None:
            return "done"
        run(commit)
        commit = pending(commit)
    if commit is None:
        return "done"
    raise RuntimeError("superseded too often; to be retried")


def revoke(repositories: DataFrame, events: DataFrame) -> DataFrame:
    """Repositories with the status ``failed`` where an event takes access away: of a whole installation, or of listed ids."""
    whole = events.where("kind = 'installation_revoked'").select(F.col("installation_id").alias("w")).distinct()
    some = events.where("kind = 'repositories_revoked'").select(F.col("installation_id").alias("s"), F.explode("removed_ids").alias("g")).distinct()
    j = repositories.join(whole, F.col("installation_id") == F.col("w"), "left").join(some, (F.col("installation_id") == F.col("s")) & (F.col("github_repository_id") == F.col("g")), "left")
    gone = F.col("w").isNotNull() | F.col("s").isNotNull()
    return j.withColumn("status", F.when(gone, "failed").otherwise(F.col("status"))).withColumn("revoked", gone).drop("w", "s", "g")


def outcome_counts(outcomes: DataFrame, by: list[str] | None = None, outcome: str = "outcome") -> DataFrame:
    """Rows by outcome (and by other columns): of pushes, deliveries, or repositories that lost their access."""
    return outcomes.groupBy(*(by or []), outcome).agg(F.count("*").alias("n"))


# -- monitoring --


def rate_windows(events: DataFrame, key: str = "user_id", at: str = "ts", length: str = RATE_WINDOW, limit: int = RATE_LIMIT) -> DataFrame:
    """Requests by key and fixed window, and whether they pass the limit."""
    return events.groupBy(F.window(at, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n", (F.col("n") > limit).alias("limited"))


def sliding_ratio(events: DataFrame, bad: Column, at: str = "ts", length: str = "10 minutes", step: str = "1 minute", floor: float = 0.001, alert: float = 0.05) -> DataFrame:
    """The share of bad events in sliding windows, by rates a second with a floor below the divisor, and whether it passes the alert."""
    w = events.groupBy(F.window(at, length, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    ratio = (F.col("bad") / seconds) / F.greatest(F.col("n") / seconds, F.lit(floor))
    return w.select(F.col("w.start").alias("start"), "n", "bad", ratio.alias("ratio"), (ratio > alert).alias("alert"))


def counters(samples: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    return samples.groupBy(*labels).agg((F.count("*") if value is None else F.sum(value)).alias("value"))


def gauges(samples: DataFrame, labels: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """The last value of each label set."""
    return samples.groupBy(*labels).agg(F.max_by(value, at).alias("value"))


def histogram(samples: DataFrame, labels: list[str], value: str, buckets: list[float]) -> DataFrame:
    """labels, le, n: cumulative counts by upper bound, the last one infinite. One partial count a bucket and label set is shuffled."""
    v = X.finite_duration(value)
    own = F.coalesce(*[F.when(v <= b, float(b)) for b in buckets], F.lit(float("inf")))
    n = samples.groupBy(*labels, own.alias("own")).agg(F.count("*").alias("n"))
    grid = n.select(*labels, "own", "n", F.explode(F.array(*[F.lit(float(b)) for b in buckets], F.lit(float("inf")))).alias("le"))
    return grid.groupBy(*labels, "le").agg(F.sum(F.when(F.col("own") <= F.col("le"), F.col("n")).otherwise(0)).alias("n"))


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """labels, quantile: linear between the bounds of the bucket that holds the rank; the last finite bound beyond them."""
    w = W.partitionBy(*labels).orderBy("le")
    total = F.max("n").over(W.partitionBy(*labels))
    b = buckets.withColumn("rank", q * total).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    hit = b.where((F.col("n") >= F.col("rank")) & (F.col("rank") > 0))
    first = hit.groupBy(*labels).agg(F.min_by(F.struct("le", "n", "low", "below", "rank"), "le").alias("h"))
    inside = F.col("h.low") + (F.col("h.le") - F.col("h.low")) * X.ratio(F.col("h.rank") - F.col("h.below"), F.col("h.n") - F.col("h.below"))
    return first.select(*labels, F.when(F.col("h.le") == float("inf"), F.col("h.low")).otherwise(inside).alias("quantile"))


def dispatch(stream: DataFrame, sinks: dict, checkpoint: str):
    """A query that hands each micro-batch to the sink of its kind; unknown kinds fail the batch."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        for kind, sink in sinks.items():
            sink(batch.where(F.col("kind") == kind), epoch)
        if not batch.where(~F.col("kind").isin(*sinks)).isEmpty():
            raise ValueError("an event of an unknown kind")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
