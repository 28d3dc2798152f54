"""Nearest neighbours by cosine from a hash-prefix forest.

Each tree holds the hash strings of all vectors in sorted order. A string is a row of digits; a digit names the nearest
of 2 * ``cells`` random directions, written sign first, so that its leading bits name a union of neighbouring cells.
A query descends in every tree to the longest prefix that it shares with the array; then all trees ascend together, a
bit at a time, until the prefixes hold ``breadth`` * sqrt(vectors) entries in all. That level is taken whole in every
tree: no bucket is cut. What the trees yield is compared exactly, in double precision.

The sorted arrays are dealt over shards at split points from a sample of at most ``SAMPLE`` vectors (by hash order);
they decide the layout only. A shard has sqrt(vectors) * ``SHARD_ROOT`` entries or more, so the shards grow in number with the
square root of the input. Equal vectors are one entry with their k + 1 smallest ids: no others can be among the k
nearest, and a vector that a third of the rows share is hashed and compared once.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows
without an id. Rows repeated in id and vector count once; an id with several vectors stands for all of them (a pair of
ids has the largest score of its rows) and is never its own neighbour. Vectors are compared with those of their own
length only. A query without candidates has no rows; an empty table gives none. Ties go to the smaller id. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.sources.session import shared_folder

#: Vectors from which the split points of the sorted arrays are taken.
SAMPLE = 4096
#: A shard of a sorted array has so many entries at least, and so many times the square root of all.
SHARD, SHARD_ROOT = 32_768, 64
#: Vectors compared in one task.
LOT = 8192
#: Queries whose candidates are brought together in one task.
GATHER = 128

_INDEX = "query boolean, tree long, shard long, key long, d long, labels binary, keys binary"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix, each scaled by a power of two so that its squares stay finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -power[:, None])


def hashed(x: np.ndarray, tree: int, digits: int, cells: int) -> np.ndarray:
    """The hash strings of one tree, as numbers of digits * log2(2 * cells) bits."""
    rng = np.random.default_rng((tree, x.shape[1]))
    bits = int(cells).bit_length()
    out = np.zeros(len(x), np.int64)
    for _ in range(digits):
        near = x @ rng.standard_normal((x.shape[1], cells), np.float32)
        best = np.abs(near).argmax(1)
        sign = near[np.arange(len(x)), best] > 0
        out = (out << bits) | (sign * cells + best)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _by_length(batch, names: tuple[str, ...] = ("key",)):
    """(length, row numbers, matrix) of a batch or table."""
    lengths = np.asarray(batch.column("d"))
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, _matrix(batch.column("vector").take(pa.array(rows)))


def _split(splits: dict, d: int, tree: int) -> np.ndarray:
    return splits.get(d, {}).get(tree, np.zeros(0, np.int64))


def _lot(keys: np.ndarray, lots: int) -> np.ndarray:
    return (keys + (keys >> 33) * 7919) % lots


def _index(batches, trees: int, digits: int, cells: int, splits: dict):
    """For each tree and shard of a batch: its hash strings and keys. Then the strings of each query."""
    for batch in batches:
        keys, asks = np.asarray(batch.column("key")), np.asarray(batch.column("query").to_pylist(), bool)
        for d, rows, x in _by_length(batch):
            x, own, asked = _unit(x), keys[rows], np.flatnonzero(asks[rows])
            strings = np.zeros((len(asked), trees), np.int64)
            out = []
            for t in range(trees):
                labels = hashed(x, t, digits, cells)
                strings[:, t] = labels[asked]
                shard = np.searchsorted(_split(splits, d, t), labels, side="right")
                order = np.argsort(shard, kind="stable")
                found, starts = np.unique(shard[order], return_index=True)
                for s, part in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                    out.append((False, d * trees + t, s, None, d, labels[part].tobytes(), own[part].tobytes()))
            out += [(True, None, None, int(own[i]), d, strings[k].tobytes(), None) for k, i in enumerate(asked)]
            yield _rows(out, _INDEX)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _probes(batches, trees: int, bits: int, splits: dict):
    """Each query's strings to its own shard and the two beside it; with a level, its range to all shards that it meets."""
    for batch in batches:
        levels = batch.column("level").to_pylist()
        out = []
        for key, d, raw, level in zip(batch.column("key").to_pylist(), batch.column("d").to_pylist(), batch.column("labels").to_pylist(), levels, strict=True):
            for t, label in enumerate(np.frombuffer(raw, np.int64).tolist()):
                cuts = _split(splits, d, t)
                if level is None:
                    own = int(np.searchsorted(cuts, label, side="right"))
                    low, high = max(0, own - 1), min(len(cuts), own + 1)
                    first, last = label, label
                else:
                    first = label >> (bits - level) << (bits - level)
                    last = first + (1 << (bits - level)) - 1
                    low, high = (int(np.searchsorted(cuts, v, side="right")) for v in (first, last))
                edge = np.array([first, last]).tobytes()
                out += [(True, d * trees + t, s, key, d, edge, None) for s in range(low, high + 1)]
        yield _rows(out, _INDEX)


def _joined(table: pa.Table, name: str, chosen: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).take(pa.array(chosen)).to_pylist()), np.int64)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's strings and keys in order, and the queries with their ranges."""
    asks = np.asarray(table.column("query").to_pylist(), bool)
    labels, keys = (_joined(table, n, np.flatnonzero(~asks)) for n in ("labels", "keys"))
    order = np.lexsort((keys, labels))
    asked = np.flatnonzero(asks)
    return labels[order], keys[order], np.asarray(table.column("key").take(pa.array(asked))), _joined(table, "labels", asked).reshape(-1, 2)


def _counted(table: pa.Table, bits: int) -> pa.Table:
    """How many entries of the shard share 0, 1, ... bits with each query."""
    labels, _, asked, edges = _sorted(table)
    counts = np.zeros((len(asked), bits + 1), np.int64)
    for level in range(bits + 1):
        low = edges[:, 0] >> (bits - level) << (bits - level)
        counts[:, level] = np.searchsorted(labels, low + (1 << (bits - level))) - np.searchsorted(labels, low)
    return pa.Table.from_batches([_rows([(int(k), c.tobytes()) for k, c in zip(asked, counts, strict=True)], "key long, counts binary")])


def _ascended(table: pa.Table, bits: int, least: int) -> pa.Table:
    """The deepest level at which the trees together have ``least`` entries for each query; 0 if none has."""
    keys, at = np.unique(np.asarray(table.column("key")), return_inverse=True)
    counts = np.zeros((len(keys), bits + 1), np.int64)
    np.add.at(counts, at, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64).reshape(-1, bits + 1))
    enough = counts >= least
    level = np.where(enough.any(1), bits - enough[:, ::-1].argmax(1), 0)
    return pa.table({"key": keys, "level": level})


def _taken(table: pa.Table) -> pa.Table:
    """The keys of a shard inside each query's range."""
    labels, keys, asked, edges = _sorted(table)
    low, high = np.searchsorted(labels, edges[:, 0]), np.searchsorted(labels, edges[:, 1], side="right")
    return pa.Table.from_batches([_rows([(int(q), keys[a:b].tobytes()) for q, a, b in zip(asked, low, high, strict=True) if b > a], "key long, keys binary")])


def _gathered(found: pa.Table, queries: pa.Table, lots: int) -> pa.Table:
    """The distinct candidates of each query, by the lot in which they are compared, with the query's vector."""
    keys = np.asarray(found.column("key"))
    order = np.argsort(keys, kind="stable")
    parts = found.column("keys").combine_chunks()
    own = np.asarray(queries.column("key"))
    lengths, vectors = queries.column("d").to_pylist(), queries.column("vector").combine_chunks()
    out = []
    for i, q in enumerate(own.tolist()):
        rows = order[np.searchsorted(keys, q, sorter=order) : np.searchsorted(keys, q, side="right", sorter=order)]
        ids = np.unique(np.frombuffer(b"".join(parts.take(pa.array(rows)).to_pylist()), np.int64))
        lot = _lot(ids, lots)
        by = np.argsort(lot, kind="stable")
        names, starts = np.unique(lot[by], return_index=True)
        vector = vectors[i].values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
        out += [(lengths[i] * lots + int(n), q, ids[part].tobytes(), vector) for n, part in zip(names, np.split(by, starts[1:]), strict=True)]
    return pa.Table.from_batches([_rows(out, "lot long, key long, keys binary, vector binary")])


def _compared(vectors: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Of each query's candidates in this lot the k + 1 nearest, ties to the smaller first id."""
    out = []
    if vectors.num_rows and asked.num_rows:
        order = np.argsort(np.asarray(vectors.column("key")))
        vectors = vectors.take(pa.array(order))
        keys, ids = np.asarray(vectors.column("key")), vectors.column("ids").to_pylist()
        first = np.array([i[0] for i in ids], np.int64)
        x = _matrix(vectors.column("vector"))
        norm = np.sqrt((x * x).sum(1))
        for q, raw, own in zip(*(asked.column(n).to_pylist() for n in ("key", "keys", "vector")), strict=True):
            at = np.searchsorted(keys, np.frombuffer(raw, np.int64))
            y = np.frombuffer(own, np.float64)
            y = np.ldexp(y, -np.frexp(np.abs(y).max())[1])
            length = np.sqrt((y * y).sum())
            rough = x[at] @ y / norm[at]
            if len(at) > k + 1:
                at = at[rough >= np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 * length]
            score = np.clip((x[at] * y).sum(1) / (norm[at] * length), -1, 1)
            best = np.lexsort((first[at], -score))[: k + 1]
            out += [(q, ids[at[b]], float(score[b])) for b in best]
    return pa.Table.from_batches([_rows(out, "key long, ids array<long>, score double")])


def _classes(vectors: DataFrame, is_query: Column, k: int, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector with its k + 1 smallest ids, the ids of queries with the hash of their vector)."""
    v = vectors.select(vectors[id_column].cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), vectors[vector_column].cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vector", lambda c: c != 0)
    v = v.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(sound)
    v = v.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    least = Window.partitionBy("h1", "h2").orderBy("id")
    ids = v.select("h1", "h2", "id").distinct().withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = v.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.max("query").alias("query"))
    classes = one.join(ids, ["h1", "h2"]).withColumn("d", F.size("vector").cast("long")).checkpoint()
    # The rows are on disk by now, so the numbers hold.
    return classes.withColumn("key", F.monotonically_increasing_id()), v.where("query").select("id", "h1", "h2").distinct()


def _splits(classes: DataFrame, n: int, trees: int, digits: int, cells: int) -> dict:
    """Of each length of vectors and each tree, the strings at which its sorted array is cut."""
    shards = math.ceil(n / max(SHARD, SHARD_ROOT * math.sqrt(n)))
    if shards < 2:
        return {}
    sample = classes.select("d", "vector", F.xxhash64("key").alias("by")).orderBy("by").limit(SAMPLE).toArrow()
    out = {}
    for d, rows, x in _by_length(sample):
        at = np.arange(1, shards) * len(rows) // shards
        out[d] = {t: np.unique(np.sort(hashed(_unit(x), t, digits, cells))[at]) for t in range(trees)}
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 48, digits: int = 4, cells: int = 128, breadth: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the forest finds for each row with ``is_query``, among all other rows."""
    shared_folder(vectors.sparkSession)
    classes, queries = _classes(vectors, is_query, k, id_column, vector_column)
    totals = classes.agg(F.count("*"), F.count_if("query")).first()
    n, asked = totals[0], totals[1]
    bits = digits * int(cells).bit_length()
    splits = _splits(classes, n, trees, digits, cells)
    lots, gathers = max(1, math.ceil(n / LOT)), max(1, math.ceil(asked / GATHER))

    index = classes.select("key", "query", "d", "vector").mapInArrow(lambda b: _index(b, trees, digits, cells, splits), _INDEX).checkpoint()
    entries, strings = index.where("not query"), index.where("query").select("key", "d", "labels")
    gather = F.pmod(F.xxhash64("key"), F.lit(gathers)).alias("gather")

    probes = strings.withColumn("level", F.lit(None).cast("long")).mapInArrow(lambda b: _probes(b, trees, bits, splits), _INDEX)
    counts = entries.unionAll(probes).groupBy("tree", "shard").applyInArrow(lambda t: _counted(t, bits), "key long, counts binary")
    levels = counts.groupBy(gather).applyInArrow(lambda t: _ascended(t, bits, math.ceil(breadth * math.sqrt(n))), "key long, level long")

    ranges = strings.join(levels, "key").mapInArrow(lambda b: _probes(b, trees, bits, splits), _INDEX)
    found = entries.unionAll(ranges).groupBy("tree", "shard").applyInArrow(_taken, "key long, keys binary")
    candidates = found.groupBy(gather).cogroup(classes.where("query").select("key", "d", "vector").groupBy(gather)).applyInArrow(lambda a, b: _gathered(a, b, lots), "lot long, key long, keys binary, vector binary")
    lot = (F.col("d") * lots + F.pmod(F.col("key") + F.shiftright("key", 33) * 7919, F.lit(lots))).alias("lot")
    best = classes.select("key", "ids", "vector", lot).groupBy("lot").cogroup(candidates.groupBy("lot")).applyInArrow(lambda a, b: _compared(a, b, k), "key long, ids array<long>, score double")

    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    rows = best.select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    rows = rows.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    answers = rows.groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")).join(classes.where("query").select("key", "h1", "h2"), "key").checkpoint()
    pairs = queries.join(answers, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score").where("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(last))
    return pairs.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
