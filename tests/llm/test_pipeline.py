"""The pipeline's stages against plain versions, and the queries that have SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltwork.llm import decontaminate, language, registry


def test_stages_by_themselves(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "duplicates", "decontamination", "secrets", "packing"]
    docs = registry.table(spark, data, "documents")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", None, None, 5), (9003, "password=abcdef0123456789abcd " * 3, "en", "s", 87)], docs.schema)
    docs = docs.unionByName(extra).withColumn("kept", F.lit("clash"))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        out[name] = {r["doc_id"]: r for r in docs.collect()}
    assert 9001 not in out["language"] and 9002 not in out["language"] and len(out["language"]) >= 195
    texts = [r["text"] for r in out["duplicates"].values()]
    assert len(set(texts)) == len(texts) and out["duplicates"].keys() <= out["language"].keys()
    bench = registry.table(spark, data, "benchmark")
    found = {r["doc_id"] for r in decontaminate.overlaps(spark.createDataFrame(list(out["duplicates"].values())), bench).collect()}
    assert out["decontamination"].keys() == out["duplicates"].keys() - found
    assert out["secrets"].keys() == out["decontamination"].keys() and not any("password=" in r["text"] for r in out["secrets"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == out["secrets"].keys()


def test_rows_are_judged_by_their_own_text(spark, data):
    docs = registry.table(spark, data, "documents")
    clean = [r["text"] for r in docs.where("lang = 'en' and n_chars between 300 and 2000").orderBy("doc_id").limit(2).collect()]
    leak = registry.table(spark, data, "benchmark").orderBy("item_id").first()["text"]
    texts = [(None, clean[0]), (None, "12 34"), (None, clean[1]), (9001, clean[0]), (9001, "12 34"), (9002, clean[1]), (9002, leak), (None, leak)]
    extra = spark.createDataFrame([(i, t, None, "own", len(t)) for i, t in texts], docs.schema)
    docs = docs.unionByName(extra)
    kept = lambda df: sorted((tuple(r) for r in df.where("source = 'own'").select("doc_id", "text").collect()), key=repr)
    want = sorted((x for x in texts if x[1] != "12 34"), key=repr)
    docs = corpus_pipeline.identify_language(spark, docs, data)
    assert kept(docs) == want
    assert kept(corpus_pipeline.remove_benchmark(spark, docs, data)) == [x for x in want if x[1] != leak]


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = c.sql(registry.oracle_sql()[name])
    at = [want.columns.index(x) for x in columns]
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_all_queries_registered():
    assert sorted(registry.queries()) == sorted(f"op{n}_{k}" for n, k in ((1, "repetition"), (2, "language"), (3, "main_text"), (4, "packing"), (5, "secrets"), (6, "warc"), (7, "similarity_join"), (8, "token_counts"), (9, "decontamination"), (10, "private_data")))
    assert language.SCHEMA.startswith("doc_id long, held_out boolean, lang_pred string, score double")
