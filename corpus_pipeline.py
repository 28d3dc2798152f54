"""A training corpus from ``documents``: each stage is written as Parquet and read again as the next one's documents.

A row is kept or dropped by its own text, whatever its doc_id: null, or shared with other rows. Null texts and texts
without a letter go in the first stage; of rows that repeat in all columns one stays after the second; an empty table
gives an empty one in each stage. All stages read whole texts of any length and pass all columns on.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import chosenpath, decontaminate, language, packing, registry, secrets
from siltwork.sources.session import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language, or of which no language has half of the letters."""
    return language.identified(docs, language.fit(docs))


def remove_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of copies and near copies."""
    return chosenpath.without_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage."""
    return decontaminate.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by a mark; no document goes."""
    return secrets.redacted(docs, secrets.fit(docs), length_column="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    return packing.pack(docs, registry.tokenizer("word_bpe_49k.json")).drop("padded_to")


#: Rows of documents that go to a Python worker at once. Spark's own number is for narrow rows: 10,000 documents are held as one
#: batch by each task in the JVM (in buffers that double as they grow) and again in its worker.
BATCH_ROWS = 1_000


def _held_small(stage):
    """The stage with smaller batches, unless the session names a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(name) == "10000":
            spark.conf.set(name, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _held_small(identify_language)),
    ("duplicates", _held_small(remove_duplicates)),
    ("decontamination", _held_small(remove_benchmark)),
    ("secrets", _held_small(mask_secrets)),
    ("packing", _held_small(pack_sequences)),
]

#: Language models, a random field and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = registry.table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"  # the result reads its last table, so it stays
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
