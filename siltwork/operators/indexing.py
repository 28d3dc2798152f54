"""Indexing a snapshot end to end, job payloads, provider errors, metrics text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.functions.checks import InvalidRows
from siltwork.operators import chunks, maintenance, symbols, vectors
from siltwork.sources import files
from siltwork.sources.session import shared_folder

JOB_KEYS = ["repositoryId", "userId", "repositoryUrl", "requestedAt", "branch"]
#: Progress in percent at the end of each step of a job.
STEPS = {"cloning": 5, "scanning": 20, "chunking": 40, "embedding": 65, "storing": 85, "completed": 100}


def _safe(c: Column, longest: int) -> Column:
    return c.isNotNull() & (c != "") & (X.trimmed(c) == c) & (X.utf16_length(c) <= longest) & ~c.contains("\0")


def parse_jobs(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Adds the fields of a job's JSON and ``valid``: known keys only, identifiers, safe strings, a time that reads back as it was written."""
    job = F.from_json(column, ", ".join(f"{k} string" for k in JOB_KEYS))
    df = payloads.withColumn("job", job)
    j = lambda k: F.col(f"job.{k}")
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    known = (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, JOB_KEYS)))) == 0)
    at = j("requestedAt")
    time = at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & (F.date_format(F.try_to_timestamp(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == at)
    ok = known & j("repositoryId").rlike("^[0-9a-f]{24}$") & j("userId").rlike("^[0-9a-f]{24}$") & _safe(j("repositoryUrl"), 2048) & _safe(at, 64) & time & (j("branch").isNull() & ~F.array_contains(keys, "branch") | _safe(j("branch"), 255))
    return df.withColumn("valid", F.coalesce(ok, F.lit(False))).select(*payloads.columns, "job.*", "valid")


def split_valid(rows: DataFrame, valid: str = "valid") -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)."""
    return rows.where(F.col(valid)), rows.where(~F.col(valid))


def index_snapshot(
    spark: SparkSession, root: str, scope: dict[str, str], persisted: DataFrame | None = None, stored: DataFrame | None = None, last_commit: str | None = None,
    strategy: str = "symbols", provider: Callable = vectors.hashing_embedder, size: int = 64,
) -> dict[str, DataFrame]:
    """The tables of a repository after indexing a directory: files, symbols, points, excluded, plan. Only files whose hash
    changed are chunked and embedded; points of removed and changed files go, retained ones carry the new commit."""
    shared_folder(spark)
    accepted, excluded = files.snapshot(spark, root)
    accepted = accepted.withColumnRenamed("path", "file_path").checkpoint()
    empty = spark.createDataFrame([], "file_path string, content_hash string, language string, chunk_count long")
    old = empty if persisted is None else persisted.select(*empty.columns)
    plan = maintenance.diff(accepted.select("file_path", "content_hash"), old, first=last_commit is None).checkpoint()
    changed = accepted.join(plan.where("status = 'changed'").select("file_path"), "file_path", "left_semi").withColumnRenamed("file_path", "path")
    parsed = symbols.extract(changed).checkpoint()
    if strategy == "symbols":
        cut = symbols.symbol_chunks(changed.select("path", "content"), parsed)
    else:
        none = F.lit(None).cast("string")
        nothing = F.array().cast("array<string>")
        cut = chunks.windows(changed.select("path", "content")).select("path", F.lit("line").alias("strategy"), nothing.alias("imports"), nothing.alias("exports"), none.alias("symbol_type"), none.alias("symbol_name"), nothing.alias("references"), "chunk_index", "start_line", "end_line", "content", "content_hash")
    cut = chunks.storable(cut).withColumnRenamed("path", "file_path").withColumns({k: F.lit(v) for k, v in scope.items()}).withColumn("language", X.language_of("file_path"))
    cut = chunks.with_ids(cut, ["user_id", "repository_id", "branch", "commit_sha"], symbol=("symbol_type", "symbol_name")).dropDuplicates(["id"])
    text = X.embedding_text("repository_id", "branch", "commit_sha", "file_path", "language", "start_line", "end_line", "imports", "exports", "content", "symbol_type", "symbol_name", "references")
    vectored = vectors.embed(cut.withColumn("text", X.with_task(text, "document")).select("id", "text"), provider, size)
    points = cut.join(vectored.select("id", "embedding"), "id").checkpoint()
    counts = points.groupBy("file_path").agg(F.count("*").alias("chunk_count"))
    new_files = changed.withColumnRenamed("path", "file_path").join(counts, "file_path", "left").select("file_path", "content_hash", "language", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    new_symbols = parsed.select(F.col("path").alias("file_path"), F.explode("symbols").alias("s")).select("file_path", "s.*")
    kept = old.join(plan.where("status = 'retained'"), "file_path", "left_semi")
    if stored is not None:
        gone = plan.where("status != 'retained'").select("file_path")
        points = maintenance.promote(stored.join(gone, "file_path", "left_anti"), scope["commit_sha"], F.lit(True)).unionByName(points)
    return {"files": kept.unionByName(new_files), "symbols": new_symbols, "points": points, "excluded": excluded, "plan": plan}


def duplicate_free(points: DataFrame, key: str = "id") -> DataFrame:
    if not points.groupBy(key).count().where("count > 1").isEmpty():
        raise InvalidRows("points share an identifier")
    return points


# Classes of provider failures by status, and whether a retry can help.
FAILURES = {401: ("AUTHENTICATION_FAILED", False), 403: ("AUTHENTICATION_FAILED", False), 404: ("MODEL_NOT_FOUND", False), 408: ("TIMEOUT", True), 429: ("RATE_LIMITED", True)}


def failure_class(status: Column) -> Column:
    """struct(code, retryable) of a provider's HTTP status."""
    one = lambda code, again: F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    chain = F.when(status.isNull(), one("UNAVAILABLE", True))
    for code, (name, again) in FAILURES.items():
        chain = chain.when(status == code, one(name, again))
    return chain.when(status >= 500, one("UNAVAILABLE", True)).otherwise(one("REQUEST_REJECTED", False))


def retry_delay(attempt: Column, base_seconds: float = 5.0) -> Column:
    """Exponential back-off: the base, then twice as long each time."""
    return F.lit(base_seconds) * F.pow(F.lit(2.0), attempt - 1)


def exposition(samples: DataFrame, name: str, labels: list[str], value: str = "value", kind: str = "counter") -> DataFrame:
    """``line`` of each sample in the text format of metrics, after the line of its type."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n")
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{l}="'), clean(F.col(l)), F.lit('"')) for l in labels])
    shown = F.concat(F.lit(name), F.lit("{") if labels else F.lit(""), pairs, F.lit("}") if labels else F.lit(""), F.lit(" "), F.col(value).cast("string"))
    head = samples.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(samples.select(shown.alias("line")))
