"""The thin queries over the whole driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import alignment, audit, chosenpath, decontaminate, forest, language, packing, pii, quality, secrets, tokencount, warc, wrappers
from siltwork.sources.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("padded_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_data(table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit.audit(docs, table(spark, sf_dir, "labels"), docs["source"])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.scored(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition, op2_language, op3_main_text, op4_packing, op5_secrets, op6_warc, op7_similarity_join, op8_token_counts, op9_decontamination, op10_private_data, op11_nearest, op12_filter_audit, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_repetition": quality.oracle(), "op9_decontamination": decontaminate.oracle(), "op12_filter_audit": audit.oracle()}
