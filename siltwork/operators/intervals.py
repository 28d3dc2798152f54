"""Interval joins: ranges of lines of one key that overlap, or lie inside each other, by bins.

A range's level is the least l for which a bin of 4 ** l places is as long as the range; there it meets two bins at most,
and at each coarser level two at most as well. Every pair of ranges is sought at the coarser of their two levels: each
side registers at its own level and probes the coarser ones that occur. So neither the length of a range nor the number of ranges
of one file decides how many rows it becomes. A pair is found in each bin that both meet and kept in the first of them.

A bin in which the two sides would make more than ``PAIRS`` pairs is split: one side is dealt over its parts, the other goes to
all of them. Ranges with a null or with an end before their start meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many pairs of one bin are left to one task.
PAIRS = 4_000_000
#: So many split bins are broadcast; more are joined by shuffle.
BROADCAST_BINS = 100_000
#: Levels 0 to 31: bins of up to 4 ** 31 places.
_LEVELS = 32


def _level(start: Column, end: Column) -> Column:
    """The least l with 4 ** l >= the range's length."""
    size = end - start + 1
    return F.size(F.filter(F.array(*[F.lit(4**k) for k in range(_LEVELS - 1)]), lambda w: w < size))


def _bin(at: Column, level: Column) -> Column:
    """at div 4 ** level, rounded down for places below zero too."""
    return F.call_function("shiftright", at, level * 2)


def _side(df: DataFrame, key: list[str], start: str, end: str, prefix: str) -> DataFrame:
    s, e = df[start].cast("long"), df[end].cast("long")
    named = df.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], s.alias(f"__{prefix}s"), e.alias(f"__{prefix}e"), F.struct(*df.columns).alias(f"__{prefix}"))
    sound = F.col(f"__{prefix}s") <= F.col(f"__{prefix}e")
    for n in range(len(key)):
        sound &= F.col(f"__k{n}").isNotNull()
    return named.where(sound).withColumn(f"__{prefix}l", _level(F.col(f"__{prefix}s"), F.col(f"__{prefix}e")).cast("int"))


def _binned(side: DataFrame, prefix: str, levels: Column) -> DataFrame:
    """A row for each bin that a range meets at the levels given."""
    s, e = F.col(f"__{prefix}s"), F.col(f"__{prefix}e")
    at = side.withColumn("__level", F.explode(levels))
    return at.withColumn("__bin", F.explode(F.sequence(_bin(s, F.col("__level")), _bin(e, F.col("__level")))))


def _met(a: DataFrame, b: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The equi-join of two binned sides with hot bins split, and the condition on each pair."""
    on = [*keys, "__level", "__bin"]
    counts = a.groupBy(*on).agg(F.count("*").alias("na")).join(b.groupBy(*on).agg(F.count("*").alias("nb")), on)
    hot = counts.where(F.col("na") * F.col("nb") > PAIRS).select(*on, F.least(F.col("na"), F.ceil(F.col("na") * F.col("nb") / PAIRS)).cast("int").alias("__parts")).checkpoint()
    n = hot.count()
    if n:
        side = F.broadcast(hot) if n <= BROADCAST_BINS else hot
        parts = F.coalesce("__parts", F.lit(1))
        a = a.join(side, on, "left").withColumn("__part", F.pmod(F.xxhash64("__as", "__ae", F.monotonically_increasing_id()), parts)).drop("__parts")
        b = b.join(side, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
        on = [*on, "__part"]
    return a.join(b, on).where(condition)


def pairs(left: DataFrame, right: DataFrame, key: list[str], contained: bool = False, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """left, right (structs of both sides' rows): each pair of ranges with equal keys that overlap, or of which the left lies inside the right, once."""
    keys = [f"__k{n}" for n in range(len(key))]
    a, b = _side(left, key, start, end, "a"), _side(right, key, start, end, "b")
    levels = sorted(r[0] for r in a.select(F.col("__al").alias("l")).union(b.select("__bl")).distinct().collect())  # 32 at most
    if not levels:
        levels = [0]
    every = F.array(*map(F.lit, levels))
    own = lambda p: F.array(F.col(f"__{p}l"))
    coarser = lambda p, strictly: F.filter(every, lambda v: v > F.col(f"__{p}l") if strictly else v >= F.col(f"__{p}l"))
    first = F.col("__bin") == _bin(F.greatest("__as", "__bs"), F.col("__level"))
    meets = (F.col("__as") <= F.col("__be")) & (F.col("__bs") <= F.col("__ae"))
    if contained:
        meets = (F.col("__as") >= F.col("__bs")) & (F.col("__ae") <= F.col("__be"))
    found = _met(_binned(a, "a", coarser("a", False)), _binned(b, "b", own("b")), keys, first & meets)
    if not contained:  # a range inside another is no longer, so its level is no coarser
        found = found.unionByName(_met(_binned(a, "a", own("a")), _binned(b, "b", coarser("b", True)), keys, first & meets))
    return found.select(F.col("__a").alias("left"), F.col("__b").alias("right"))


def marked(left: DataFrame, right: DataFrame, key: list[str], contained: bool = False, start: str = "start_line", end: str = "end_line", name: str = "hit") -> DataFrame:
    """The left rows with whether any right range overlaps (or contains) theirs. Ranges are compared by value, so repeated ones cost nothing."""
    at = [*key, start, end]
    found = pairs(left.select(*at).distinct(), right.select(*at).distinct(), key, contained, start, end)
    found = found.select(*[F.col(f"left.{c}").alias(f"__{c}") for c in at]).distinct().withColumn(name, F.lit(True))
    on = [left[c] == found[f"__{c}"] for c in at]
    return left.join(found, on, "left").drop(*[f"__{c}" for c in at]).withColumn(name, F.coalesce(F.col(name), F.lit(False)))
