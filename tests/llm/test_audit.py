import os
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from siltwork.llm import audit

DOCS = "doc_id long, text string, source string"


def plain(docs, labels):
    """Every order applied row by row."""
    ws = " \t\n\x0b\x0c\r"
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = "".join(" " if c in ws else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in first and i > first[t]}
        rows.append((s or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, gone = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                gone[part, f] = gone.get((part, f), 0) + len(removed)
                failing = sum(r[1][f] for r in own)
                unique = sum(r[1][f] and not any(r[1][g] for g in "ABCDE" if g != f) for r in own)
                out[part, "".join(order), k + 1] = (len(left), len(removed), failing - len(removed), unique, sum(r[2] for r in removed), sum(r[3] for r in removed))
    return {(*k, *v, gone[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(df):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_every_order_against_a_plain_version(spark):
    long = " ".join(f"w{k}" for k in range(260))
    docs = [
        (1, long, "a"), (2, long, "a"), (3, long + " #", "a"), (4, "short", None), (5, None, None), (6, "", "b"), (7, "x " * 300, "b"), (8, "ABC " * 210, "b"), (None, long, "b"), (2, long, "b"),
        (9, " ".join(["w"] * 300), "b"), (10, "w\x0bx\ty\x1cz " * 150, "b"), (11, long.upper(), "c"), (12, "é" * 50_000, "c"), (13, "A" + "e" * 49, "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, None, 1), (None, 1, 1), (11, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame(docs, DOCS).withColumns({"A": F.lit(1), "part": F.lit("clash"), "good": F.lit(3)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(audit.audit(d, lab, d["source"])) == plain(docs, labels)


def test_a_node_is_visited_once_and_orders_share_its_counts(spark):
    df = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, True) for i in range(60)], "part string, X boolean, Y boolean, Z boolean, bad boolean")
    got = audit.interactions(df, "XYZ", losses=("bad",)).collect()
    assert len(got) == 18 and {r.filter_order for r in got} == {"".join(p) for p in permutations("XYZ")}
    kept = {r.filter_order: r.kept for r in got if r.step == 3}
    assert set(kept.values()) == {sum(1 for i in range(60) if i % 2 and i % 3 and i % 5)}
    assert {r.filter_order[:2]: r.kept for r in got if r.step == 2}["XY"] == sum(1 for i in range(60) if i % 2 and i % 3)
    assert all(r.bad_lost == r.removed for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(d, lab, d["source"]).count() == 0
    one = spark.createDataFrame([(1, "x", None)], DOCS)
    got = rows(audit.audit(one, lab, one["source"]))
    assert len(got) == 600 and got == plain([(1, "x", None)], [])


def test_given_tables_against_sql(spark, data):
    docs, lab = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(data, t)}.parquet'")
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert rows(audit.audit(docs, lab, docs["source"])) == set(con.execute(f"SELECT {names} FROM ({audit.oracle()})").fetchall())
