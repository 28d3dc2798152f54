"""How tables lie on disk: buckets for joins by key, Bloom filters for look-ups by keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.checks import InvalidRows


def keyword_options(columns: list[str], distinct: int = 1_000_000) -> dict[str, str]:
    """Parquet options for Bloom filters on columns that are looked up by equality; ``distinct`` values are expected in a file."""
    out = {}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out[f"parquet.bloom.filter.expected.ndv#{c}"] = str(distinct)
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, keywords: list[str] | None = None) -> None:
    """Saves a table in buckets of a key, sorted inside: tables of equal buckets are joined by the key without an exchange."""
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite")
    for option, value in keyword_options(keywords or []).items():
        writer = writer.option(option, value)
    writer.saveAsTable(name)


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def ensure_vectors(spark: SparkSession, name: str, points: DataFrame, dimensions: int, buckets: int = 32, keywords: tuple[str, ...] = ("symbol_name", "file_path")) -> None:
    """A bucketed table of points with Bloom filters on its keyword columns, or a check that the one there has the same
    dimensions, buckets and keywords."""
    want = {"siltwork.dimensions": str(dimensions), "siltwork.buckets": str(buckets), "siltwork.keywords": ",".join(keywords)}
    if not spark.catalog.tableExists(name):
        bucketed(points, name, "id", buckets, list(keywords))
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f"'{k}' = '{v}'" for k, v in want.items())})")
        return
    have = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if wrong := [k for k, v in want.items() if have.get(k) != v]:
        raise InvalidRows(f"{name}: other {', '.join(wrong)}")


def healthy(spark: SparkSession, name: str) -> bool:
    """Whether the table is there and one of its rows can be read."""
    try:
        spark.table(name).limit(1).count()
    except Exception:  # noqa: BLE001  any failure is the answer
        return False
    return True
