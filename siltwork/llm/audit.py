"""Filter interaction audit by a trie of filter orders.

All orders of the filters form a trie; a node's survivors depend on the set of filters above it only. The trie is
walked depth first: at a node the survivors are a persisted DataFrame, each edge (the next filter) counts what it
removes from them, and the child is what it leaves. A set that was reached by another order is not visited again; its
counted edges are shared. With five filters 31 nodes with 80 edges stand for 120 orders of five steps.

Whether a row fails a filter does not depend on the other filters, so texts are judged once: survivors hold the part,
one flag for each filter and two labels. At most one DataFrame a level is persisted at a time; each node's counts are
written to the shared folder, so a lost executor costs its partitions of the slim rows only.

Defined results: a null text is an empty one, a null part the empty string; repeated rows count each on its own. A
document without an id is never a later copy, nor the first of one. Labels of one doc_id are joined into one (a 1 in any
row counts); without a label a row is neither good nor toxic. Empty texts fail A only. Clashing columns are not read.
An empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.sources.session import shared_folder

_SPACE = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents with flags A to E: whether they fail each of five filters on their whole text."""
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.withColumns({"__text": text, "__id": docs[id_column].cast("long"), "__key": F.sha2(text, 256), "__words": F.array_remove(F.split(text, _SPACE), "")})
    copies = rows.groupBy("__key").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n").checkpoint()
    rows = rows.withColumns({
        "A": F.size("__words") < 200,
        "B": F.size(F.array_distinct("__words")) * 100 < F.size("__words") * 50,
        "C": F.length(F.regexp_replace("__text", "[^A-Z]", "")) * 100 > F.length("__text") * 2,
        "D": F.col("__text").rlike(r"[#$%&*|]"),
    }).drop("__text", "__words")
    return rows.join(copies, "__key", "left").withColumn("E", F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))).drop("__key", "__first", "__id")


def interactions(rows: DataFrame, filters: str = "ABCDE", part: str = "part", losses: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, order and step. ``rows``: a part, one boolean column per filter (true if it fails) and one per loss."""
    spark = rows.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"  # the result reads it, so it stays
    rows.select(part, *filters, *losses).write.parquet(f"{place}/rows")
    base = spark.read.parquet(f"{place}/rows")
    number, done = {f: 1 << k for k, f in enumerate(filters)}, set()

    def visit(state: int, survivors: DataFrame) -> None:
        """Counts the edges of this state on its survivors, then goes down where no order has been."""
        done.add(state)
        left = [f for f in filters if not state & number[f]]
        sums = [F.count_if(f).alias(f"{f}_removed") for f in left] + [F.count_if(F.col(f) & F.col(x)).alias(f"{f}_{x}") for f in left for x in losses]
        edge = lambda f: F.struct(F.lit(f).alias("filter"), F.col(f"{f}_removed").alias("removed"), (F.col("alive") - F.col(f"{f}_removed")).alias("kept"), *[F.col(f"{f}_{x}").alias(f"{x}_lost") for x in losses])
        counts = survivors.groupBy(part).agg(F.count("*").alias("alive"), *sums)
        counts.select(part, F.lit(state).alias("state"), F.explode(F.array(*map(edge, left))).alias("e")).select(part, "state", "e.*").write.mode("append").parquet(f"{place}/edges")
        for f in left:
            below = state | number[f]
            if len(left) > 1 and below not in done:
                child = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(below, child)
                child.unpersist()

    visit(0, base)
    every = [(s, f) for s in range(1 << len(filters)) for f in filters if not s & number[f]]
    counted = ["removed", "kept", *[f"{x}_lost" for x in losses]]
    edges = spark.read.parquet(f"{place}/edges")
    # A part of which a state has no survivors has no row there: its counts are zero.
    nil = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in every])
    zeros = edges.where((F.col("state") == 0) & (F.col("filter") == filters[0])).select(part, F.explode(nil).alias("e")).select(part, "e.*", *[F.lit(0).cast("long").alias(c) for c in counted])
    edges = edges.select(part, "state", "filter", *counted).unionByName(zeros).groupBy(part, "state", "filter").agg(*[F.sum(c).alias(c) for c in counted])
    every_other = (1 << len(filters)) - 1
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(filters) - 1 - k)) for k in range(len(filters))]), F.bit_count("state") + 1)
    own = F.element_at(F.create_map(*[F.lit(x) for f in filters for x in (f, number[f])]), F.col("filter"))
    whole = edges.groupBy(part, "filter").agg(
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("__failing"),
        F.max(F.when(F.col("state") == F.lit(every_other) - own, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    steps = []
    for order in permutations(filters):
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, sum(number[x] for x in order[:k]), f))
    plan = spark.createDataFrame(steps, "filter_order string, step int, state int, filter string")
    found = edges.join(whole, [part, "filter"]).join(F.broadcast(plan), ["state", "filter"])
    return found.select(part, "filter_order", "step", "kept", "removed", (F.col("__failing") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{x}_lost" for x in losses], "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """The five filters of :func:`failures` over documents, with what each step costs of good and toxic ones."""
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("__label")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic")).checkpoint()
    slim = docs.select("doc_id", "text", F.coalesce(part.cast("string"), F.lit("")).alias("part"))
    judged = failures(slim).drop("text")
    judged = judged.join(marks, judged["doc_id"].cast("long") == F.col("__label"), "left")
    return interactions(judged.withColumns({x: F.coalesce(F.col(x), F.lit(False)) for x in ("good", "toxic")}))


def oracle() -> str:
    """DuckDB SQL for the rows of :func:`audit` over ``documents`` and ``labels``."""
    return r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
j AS (SELECT doc_id, part,
  (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails FROM w),
l AS (SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM j LEFT JOIN l ON label_id = doc_id GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || x.f || d.f || e.f AS filter_order FROM f a, f b, f x, f d, f e WHERE a.bit | b.bit | x.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, filter_order[step] AS f, (SELECT coalesce(sum(bit), 0) FROM f WHERE position(f IN filter_order) < step)::BIGINT AS state
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT c.part, s.filter_order, s.step, s.f,
  sum(CASE WHEN fails & (state | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & state = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & state <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & state = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & state = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN s JOIN f ON f.f = s.f GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
