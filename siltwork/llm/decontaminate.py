"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A document is contaminated by an item if at least min(``least``, 80 % of the item's words) words match on one
alignment (document position minus item position) within ``WINDOW`` consecutive words of the item; an item of up to
so many words counts as a whole. So a long item needs as dense a match as a short one: chance matches of common words
add up along an alignment, but not within a window. Items of under ``SPAN`` words are sought as whole sequences, down to a
single word; an item without a word matches nothing.

No such window is missed: if t of n words match, three neighbours among them lie within (n - 1) / ((t - 1) / 2)
words (rounded down), and two of these within half of that. So the fixed masks keep two words at each distance up to
that half and ignore what stands between; their hashes are joined with those of the items, and a hit with a third
match near it has the item compared word by word, substitutions allowed, as far as a window around the hit reaches.
Items of one or two words are joined by the word or the pair.

Words are maximal runs of letters and digits, in lower case; texts of any length are read whole. Defined results:
null and empty texts match nothing; the best alignment is reported for each doc_id and item, over all rows
repeated under a doc_id; a null item_id is reported as null; other columns are not read; empty tables give an empty
table. :func:`clean` keeps or drops each row by its own text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.chosenpath import number

#: Items of at least so many words need not match as a whole.
SPAN = 8
#: The matches that count lie within so many consecutive words of an item; one 64-bit number holds their bits.
WINDOW = 64
#: So many pairs, each with the words of its item, are broadcast at once; more are sought in several passes.
BROADCAST_SEEDS = 300_000
#: So many contaminated rows' numbers are broadcast; more are joined by shuffle.
BROADCAST_FOUND = 1_000_000


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _least(n: int, least: int) -> int:
    """The words that must match of an item of n words."""
    return n if n < SPAN else min(least, math.ceil(n * 0.8))


def _reach(n: int, t: int) -> int:
    """Within so many words three neighbours of t matches among n words must lie."""
    return (n - 1) // ((t - 1) // 2) if t >= 3 else n


def _hits(own: DataFrame, items: DataFrame, reach: int, single: bool) -> DataFrame:
    """The matched positions of items (``k``) around each place where a pair and a third word match within ``reach`` words."""
    gaps = range(1, max(1, reach // 2) + 1)
    pair = lambda words, at, g: F.when(F.get(words, at + g).isNotNull(), F.xxhash64(F.lit(g), F.get(words, at), F.get(words, at + g)))
    word = lambda words, at: F.xxhash64(F.lit(0), F.get(words, at))
    at = items.select("*", F.posexplode("own").alias("at", "first")).drop("first")
    seeds = at.select("*", F.explode(F.array(F.when(F.col("n") == 1, word("own", F.col("at"))), *[pair("own", F.col("at"), g) for g in gaps])).alias("seed")).where("seed is not null")
    masks = [pair("w", F.col("pos"), g) for g in gaps] + ([word("w", F.col("pos"))] if single else [])
    hits = own.select("*", F.explode(F.array(*masks)).alias("seed")).where("seed is not null").join(F.broadcast(seeds), "seed")
    # get() is null before the start and after the end, so nothing matches there.
    same = reduce(lambda a, b: a + b, [F.when(F.get("w", F.col("pos") + k) == F.get("own", F.col("at") + k), 1).otherwise(0) for k in range(1 - reach, reach + 1)])
    begin = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    near = hits.where(same >= F.least(F.lit(3), F.col("n"))).withColumns({"line": F.col("pos") - F.col("at"), "begin": begin})
    near = near.select("doc_id", "row", "w", "item", "item_id", "n", "t", "line", "begin", F.posexplode(F.slice("own", F.col("begin") + 1, F.lit(2 * WINDOW - 1))).alias("k", "word"))
    near = near.withColumn("k", F.col("begin") + F.col("k"))
    return near.where(F.get("w", F.col("line") + F.col("k")) == F.col("word")).drop("w", "word", "begin")


def _densest(blocks: Column) -> Column:
    """The most bits in ``WINDOW`` consecutive places, of blocks (block, bits) in order; a window that begins in an absent block has no more than one that begins with the next."""
    def windows(x: Column, i: Column) -> Column:
        after = F.get(blocks, i + 1)
        rest = F.when(after["block"] == x["block"] + 1, after["bits"]).otherwise(F.lit(0).cast("long"))
        # The low r bits of the next block; of none of them where r is 0.
        return F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda r: F.bit_count(F.call_function("shiftrightunsigned", x["bits"], r)) + F.bit_count(rest.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), r)))))

    return F.array_max(F.flatten(F.transform(blocks, windows)))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched_words, item_words of contaminated documents. Documents are not shuffled; matches are grouped by alignment."""
    items = benchmark.select(F.xxhash64(benchmark[item_column].cast("long"), benchmark[item_text]).alias("item"), benchmark[item_column].cast("long").alias("item_id"), words(benchmark[item_text]).alias("own"))
    items = items.withColumn("n", F.size("own")).where(F.get("own", F.lit(0)) != "").distinct()
    items = items.withColumn("t", F.when(F.col("n") < SPAN, F.col("n")).otherwise(F.least(F.lit(least), F.ceil(F.col("n") * 0.8).cast("int"))))
    sizes = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}  # one row for each length of items
    reach = max((_reach(min(n, WINDOW), _least(n, least)) for n in sizes), default=2)

    src = docs.select(docs[id_column].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(docs[text_column]).alias("w"))
    own = src.select("doc_id", "row", "w", F.posexplode("w").alias("pos", "word")).where("word != ''")
    passes = max(1, math.ceil(sum(n * k for n, k in sizes.items()) * max(1, reach // 2) / BROADCAST_SEEDS))
    found = reduce(DataFrame.unionAll, [_hits(own, items.where(F.pmod("item", F.lit(passes)) == k), reach, 1 in sizes) for k in range(passes)])
    # The item's matched positions as bits in blocks of 64: an alignment that several pairs hit counts once.
    keys = ["doc_id", "row", "item", "item_id", "n", "t", "line"]
    blocks = found.groupBy(*keys, F.expr("k div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, k % 64))").alias("bits"))
    lines = blocks.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("all"), F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("blocks")).where(F.col("all") >= F.col("t"))
    lines = lines.withColumn("matched", F.when(F.col("n") <= WINDOW, F.col("all")).otherwise(_densest(F.col("blocks"))).cast("long")).where("matched >= t")
    return lines.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched_words"), F.max(F.col("n").cast("long")).alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents, all columns, whose own text is not contaminated."""
    numbered = docs.withColumn("__row", number(docs[id_column].cast("long"), docs[options.get("text_column", "text")]))
    found = overlaps(numbered, benchmark, id_column="__row", **options).select(F.col("doc_id").alias("__contaminated")).distinct().checkpoint()
    found = F.broadcast(found) if found.count() <= BROADCAST_FOUND else found
    return numbered.join(found, F.col("__row") == F.col("__contaminated"), "left_anti").drop("__row")


def oracle(least: int = 13) -> str:
    """DuckDB SQL for the rows of :func:`overlaps` over ``documents`` and ``benchmark``: alignments that share a pair of
    words (or a word, for items that need it), then the densest window of all matches on each."""
    half = _reach(WINDOW, least) // 2
    lead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY id ORDER BY pos) AS w{k}" for k in range(1, half + 1))
    pairs = "[w] || [x for x in [" + ", ".join(f"'{k} ' || w || ' ' || w{k}" for k in range(1, half + 1)) + "] if x is not null]"

    def side(table: str, column: str) -> str:
        return rf"""SELECT id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos
          FROM (SELECT {column} AS id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM {table}) WHERE ws[1] <> ''"""

    return f"""
WITH d AS ({side("documents", "doc_id")}), b0 AS ({side("benchmark", "item_id")}),
b AS (SELECT *, CASE WHEN n < {SPAN} THEN n ELSE least({least}, CAST(ceil(n * 0.8) AS BIGINT)) END AS t FROM b0),
dk AS (SELECT id, pos, unnest({pairs}) AS k FROM (SELECT *, {lead} FROM d)),
bk AS (SELECT id, pos, t, unnest({pairs}) AS k FROM (SELECT *, {lead} FROM b)),
s AS (SELECT * FROM bk WHERE contains(k, ' ') = (t >= 3)),
h AS (SELECT DISTINCT dk.id AS doc_id, s.id AS item_id, dk.pos - s.pos AS line FROM dk JOIN s USING (k)),
l AS (SELECT h.doc_id, h.item_id, b.n, b.t, count(*) OVER (PARTITION BY h.doc_id, h.item_id, h.line ORDER BY b.pos RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m
  FROM h JOIN b ON b.id = h.item_id JOIN d ON d.id = h.doc_id AND d.pos = h.line + b.pos AND d.w = b.w)
SELECT doc_id, item_id, max(m) AS matched_words, max(n) AS item_words FROM l WHERE m >= t GROUP BY doc_id, item_id"""
