"""Overlapping line windows with content hashes and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.functions.checks import holds, total_at_most

SIZE, OVERLAP, MAX_PER_FILE, MAX_CHUNKS, MAX_CHARACTERS = 120, 20, 10_000, 100_000, 500 << 10


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r\n|\n|\r", -1)


def window_count(lines: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return F.when(lines <= size, 1).otherwise(1 + F.ceil((lines - size) / (size - overlap))).cast("int")


def windows(df: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP, first_line: Column | None = None) -> DataFrame:
    """A row per window: all columns of df but the content, then chunk_index, start_line, end_line, content, content_hash.
    An empty content has none; the last window is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    rest = [c for c in df.columns if c != content]
    lines = df.where(F.length(content) > 0).select(*rest, lines_of(F.col(content)).alias("__lines"), (F.lit(1) if first_line is None else first_line).alias("__first"))
    cut = lines.select(*rest, "__lines", "__first", F.explode(F.sequence(F.lit(0), window_count(F.size("__lines"), size, overlap) - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    text = F.array_join(F.slice("__lines", start + 1, size), "\n")
    out = cut.select(*rest, "chunk_index", (F.col("__first") + start).alias("start_line"), (F.col("__first") + F.least(start + size, F.size("__lines")) - 1).alias("end_line"), text.alias("content"))
    return out.withColumn("content_hash", X.sha256("content"))


def with_ids(chunks: DataFrame, scope: list[str], path: str = "file_path", symbol: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``id``: the same place with the same content has the same identifier in every run."""
    parts = [*scope, path, "start_line", "end_line", "content_hash"]
    extra = [F.coalesce(F.col(s), F.lit("")) for s in symbol] if symbol else []
    plain = X.uuid_of(*parts)
    named = F.when(F.coalesce(*[F.col(s) for s in symbol]).isNotNull(), X.uuid_of(*parts, *extra)).otherwise(plain) if symbol else plain
    return chunks.withColumn("id", named)


def within_caps(files: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The files, if none is too long or has too many windows, and all have not too many."""
    n = F.when(F.length(content) > 0, window_count(F.size(lines_of(F.col(content))), size, overlap)).otherwise(0)
    files = holds(files, (X.utf16_length(content) <= MAX_CHARACTERS) & (n <= MAX_PER_FILE), "a file is beyond its chunk limits")
    return total_at_most(files, n, MAX_CHUNKS, "chunks")


def summaries(chunks: DataFrame, key: list[str]) -> DataFrame:
    return chunks.groupBy(*key).agg(F.count("*").alias("chunk_count"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(X.utf16_length("content")).alias("characters"))


def storable(chunks: DataFrame) -> DataFrame:
    """Chunks with something other than white space: blank ones are not embedded."""
    return chunks.where(X.trimmed("content") != "")
