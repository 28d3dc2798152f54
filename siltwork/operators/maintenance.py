"""Incremental maintenance: snapshot diff, roll-up, and changes to stored tables as plans over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.checks import InvalidRows, at_most, unique


def diff(current: DataFrame, persisted: DataFrame, key: str = "file_path", digest: str = "content_hash", count: str = "chunk_count", first: bool = False) -> DataFrame:
    """key, status (changed, retained, removed), mode. ``full`` mode (a first index, or rows without a chunk count) changes all current files."""
    full = first or not persisted.where(F.col(count).isNull()).isEmpty()
    new = current.select(F.col(key), F.col(digest).alias("new_hash"))
    old = persisted.select(F.col(key), F.col(digest).alias("old_hash"))
    status = F.when(F.col("new_hash").isNull(), "removed").when(F.lit(full) | F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash")), "changed").otherwise("retained")
    return unique(new, key).join(unique(old, key), key, "full_outer").select(key, status.alias("status"), F.lit("full" if full else "incremental").alias("mode"))


def rollup(plan: DataFrame, persisted: DataFrame, indexed: DataFrame, key: str = "file_path") -> DataFrame:
    """One row: total_files, total_chunks and files by language of what is retained and what was indexed anew."""
    retained = persisted.join(plan.where("status = 'retained'"), key, "left_semi")
    both = retained.select("language", "chunk_count").unionByName(indexed.select("language", "chunk_count"))
    by = both.groupBy("language").agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))
    return by.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files")))).alias("languages"))


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the source replace those of the target with the same key."""
    return target.join(unique(source, key).select(key), key, "left_anti").unionByName(source)


def delete_scope(target: DataFrame, **scope) -> DataFrame:
    """Without the rows of a scope; a scope needs a user and a repository."""
    if not {"user_id", "repository_id"} <= scope.keys():
        raise ValueError("a scope needs user_id and repository_id")
    hit: Column = F.lit(True)
    for name, value in scope.items():
        hit = hit & (F.col(name) == value)
    return target.where(~F.coalesce(hit, F.lit(False)))


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str], most: int | None = 5_000) -> DataFrame:
    keys = keys.select(*on).distinct()
    return target.join(keys if most is None else at_most(keys, most, "paths"), on, "left_anti")


def promote(target: DataFrame, commit: str, scope: Column) -> DataFrame:
    """All rows of the scope carry the new commit."""
    return target.withColumn("commit_sha", F.when(scope, F.lit(commit)).otherwise(F.col("commit_sha")))


def commit_files(files: DataFrame, symbols: DataFrame, plan: DataFrame, new_files: DataFrame, new_symbols: DataFrame, commit: str, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """(files, symbols) after an index run: removed ones go, changed ones are replaced, retained ones are stamped anew."""
    gone = plan.where("status != 'retained'").select(key)
    kept = files.join(gone, key, "left_anti").withColumn("commit_sha", F.lit(commit))
    return kept.unionByName(new_files), symbols.join(gone, key, "left_anti").unionByName(new_symbols)


def compare_and_set(control: DataFrame, key: Column, expected: Column, **new) -> DataFrame:
    """A control table with new values in the row of the key if what is expected holds; else it fails."""
    if control.where(key & expected).isEmpty():
        raise InvalidRows("the row was changed meanwhile")
    for name, value in new.items():
        control = control.withColumn(name, F.when(key, F.lit(value)).otherwise(F.col(name)))
    return control


def job_view(log: DataFrame) -> DataFrame:
    """The latest state of each job from an append-only log(job_id, at, status, progress, step)."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "step", "at"), F.struct("at", "progress")).alias("s")).select("job_id", "s.*")


def store_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that df has rows for; write to a path that df does not read."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def create_or_verify(spark, name: str, schema: str, dimensions: int, distance: str = "cosine") -> None:
    """A table of vectors with its dimension and distance, or a check that the one there has the same."""
    want = {"siltwork.dimensions": str(dimensions), "siltwork.distance": distance}
    if not spark.catalog.tableExists(name):
        options = ", ".join(f"'{k}' = '{v}'" for k, v in want.items())
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet TBLPROPERTIES ({options})")
        return
    have = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if any(have.get(k) != v for k, v in want.items()):
        raise InvalidRows(f"{name} holds other vectors")
