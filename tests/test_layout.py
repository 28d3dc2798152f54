"""Buckets and Bloom filters, as the plans and the files show them."""

import pytest
from pyspark.sql import functions as F

from siltwork.functions.checks import InvalidRows
from siltwork.sources import layout, manifest


def rows(df):
    return sorted(map(tuple, df.collect()))


def scanned(df):
    """Rows that the file scan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    node, seen = [plan], []
    while node:
        n = node.pop()
        if "Scan" in n.nodeName():
            seen.append(n.metrics().get("numOutputRows").get().value())
        inner = n.children()
        node += [inner.apply(i) for i in range(inner.size())]
        if n.nodeName() == "AdaptiveSparkPlan":
            node.append(n.executedPlan())
    return sum(seen)


def test_join_of_bucketed_tables_has_no_exchange(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    layout.bucketed(df, "left_b", "id", 4)
    layout.bucketed(df.where("v = 3"), "right_b", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("left_b").join(spark.table("right_b").withColumnRenamed("v", "w"), "id")
        assert j.count() == 143
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_b")
        spark.sql("DROP TABLE right_b")


def test_bloom_filters_leave_files_out(spark, tmp_path):
    df = spark.range(4000).select("id", F.format_string("s%06d", F.col("id") * 2).alias("symbol_name")).repartition(4)
    for name, keywords in (("plain", []), ("bloom", ["symbol_name"])):
        w = df.write
        for option, value in layout.keyword_options(keywords, 5000).items():
            w = w.option(option, value)
        w.option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/{name}")
    absent = lambda name: spark.read.parquet(f"{tmp_path}/{name}").where("symbol_name = 's000777'")  # noqa: E731  between the least and the greatest
    assert scanned(absent("plain")) > 0 and scanned(absent("bloom")) == 0
    assert spark.read.parquet(f"{tmp_path}/bloom").where("symbol_name = 's000778'").count() == 1


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    store = manifest.Store(spark, f"file://{tmp_path}/s")
    t = store.transaction()
    assert t.upsert("points", spark.range(200).selectExpr("id", "'old' AS v"), "id", buckets=8) == 8
    t.commit()
    before = store.state()["tables"]["points"]["at"]
    t = store.transaction()
    assert t.upsert("points", spark.createDataFrame([(5, "new"), (1000, "new")], "id long, v string"), "id", buckets=99) <= 2
    t.commit()
    after = store.state()["tables"]["points"]["at"]
    assert sum(before[b] != after[b] for b in before) <= 2 and len(after) == 8
    assert rows(store.read("points")) == [(i, "new" if i == 5 else "old") for i in range(200)] + [(1000, "new")]
    assert rows(store.read("points", 1)) == [(i, "old") for i in range(200)]
    one, two = store.transaction(), store.transaction()
    for t in (one, two):
        t.upsert("points", spark.createDataFrame([(6, "x")], "id long, v string"), "id")
    one.commit()
    with pytest.raises(manifest.Conflict):
        two.commit()
    with pytest.raises(InvalidRows):
        store.transaction().upsert("points", spark.createDataFrame([(6, "x"), (6, "y")], "id long, v string"), "id")
    with pytest.raises(manifest.Conflict):
        store.transaction().upsert("points", spark.createDataFrame([("a", 1)], "v string, id long"), "v")


def test_points_are_ensured(spark):
    points = spark.range(10).selectExpr("string(id) AS id", "'f' AS symbol_name", "'p' AS file_path")
    assert not layout.healthy(spark, "points_t")
    try:
        layout.ensure_vectors(spark, "points_t", points, 8, buckets=2)
        layout.ensure_vectors(spark, "points_t", points, 8, buckets=2)
        assert layout.healthy(spark, "points_t") and spark.table("points_t").count() == 10
        with pytest.raises(InvalidRows, match="dimensions"):
            layout.ensure_vectors(spark, "points_t", points, 16, buckets=2)
    finally:
        spark.sql("DROP TABLE IF EXISTS points_t")
