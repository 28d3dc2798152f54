"""Nearest neighbours of many queries by an inverted file, exact by bounds.

Centres are fitted on a bounded sample; every point lies in the list of its nearest centre. A block of queries first visits,
slice by slice, its rows' own lists and the ``probes`` lists nearest to the slice. What it has found then bounds the rest: a list whose centre is
further off than the k-th neighbour by more than the list's radius holds no better one; all others are visited. So the
result is that of comparing every pair, while well-parted lists are left out. Points and queries are packed into blocks of
bounded size, list by list, one row a block; a product of the blocks brings each block of queries to the blocks that hold a
list that it wants, so few of them are read that a pair of blocks costs far more time than its way into a task. No vector
is sent once for each list, a task holds two blocks whatever the input, and nothing passes through the driver but centres
and radii. Blocks hold the vectors as they are stored (single precision stays four bytes a component). A product in single precision, whose error is bounded, finds the
pairs that may count; their scores are then taken in double precision, vector by vector. Products and angles to the centres
are taken for ``SLICE`` rows at a time, so that a task's memory does not grow with the number of centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.sources.session import shared_folder

#: Points from which the centres are fitted, and how many there are at most.
SAMPLE, CENTRES = 20_000, 4096
#: Rows and bytes of a block of points at most, a block of queries is half as large; rows of which products and angles are held at once.
PART, PART_BYTES, SLICE = 32_768, 8 << 20, 512
_ROUNDS = 8
_SLACK = 1e-7  # of angles, for what rounding may move
_NEAR = 1e-12  # of cosines, likewise: a product's last digits depend on a row's place in its block


def _units(vectors) -> np.ndarray:
    x = np.array(list(vectors), float)
    x = x.reshape(len(x), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _lists(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the list and the angle to its centre."""
    own, least, step = [np.zeros(0, np.int32)], [np.zeros(0)], min(PART, SLICE)
    for i in range(0, len(x), step):
        angle = _angles(x[i : i + step], centres)
        own.append(angle.argmin(1).astype(np.int32))
        least.append(angle[np.arange(len(angle)), own[-1]])
    return np.concatenate(own), np.concatenate(least)


def fit(points: DataFrame, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Unit centres, about as many as the square root of the points, by k-means on at most ``SAMPLE`` of them (by hash
    order); near ones follow each other, so that blocks hold lists that are wanted together."""
    n = points.count()
    sample = _units(points.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toPandas()[vector]) if n else np.zeros((0, 1))
    many = max(1, min(math.ceil(math.sqrt(n)), CENTRES, math.ceil(len(sample) / 4)))
    centres = sample[:: max(1, len(sample) // many)][:many].copy()
    for _ in range(_ROUNDS):
        nearest = _lists(sample, centres)[0]
        for c in np.unique(nearest):
            mean = sample[nearest == c].sum(0)
            if np.linalg.norm(mean) > 1e-12:
                centres[c] = mean / np.linalg.norm(mean)
    coarse = centres[:: math.ceil(math.sqrt(len(centres)))] if many > 1 else centres
    return centres[_lists(centres, coarse)[0].argsort(kind="stable")]


def _ranked(row: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties by key; sorted by row."""
    order = np.lexsort((key, -score, row))
    row, key, score = row[order], key[order], score[order]
    starts = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, int)
    kept = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < k
    return row[kept], key[kept], score[kept]


def _among(s: np.ndarray, least: np.ndarray, near: float, k: int) -> np.ndarray:
    """Which products, each at most ``near`` off, may be among the k largest of their row and at least ``least``."""
    rows, cols = s.shape
    hit, groups = s >= (least - near)[:, None].astype(s.dtype), max(32, 4 * k)
    if cols >= 2 * groups and np.count_nonzero(hit) > 2 * k * rows:
        # Of the largest of each group of columns, k are not below the k-th: nor is the k-th of all.
        each = s[:, : cols // groups * groups].reshape(rows, groups, -1).max(2)
        hit &= s >= (np.partition(each, groups - k, axis=1)[:, groups - k] - 2 * near)[:, None]
    return hit


def _candidates(x: np.ndarray, ids: np.ndarray, p: np.ndarray, keys: np.ndarray, thin: tuple[np.ndarray, np.ndarray], own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and score of the points that may be among the k nearest of each query; a query's own key is none of them.
    ``thin`` are queries and points in single precision, ``own`` the points whose keys are queries' as well."""

    def product(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s = a @ b.T
        if len(own):
            r, c = np.nonzero(ids[:, None] == keys[None, own])
            s[r, own[c]] = -np.inf
        return s

    s = product(*thin, ids)
    at = np.flatnonzero(_among(s, least, (x.shape[1] + 16) * 2.0**-24, k))
    r, c = np.divmod(at[s.ravel()[at] > -np.inf], len(keys))
    many = np.bincount(r, minlength=len(x)) > 16 * k
    if many.any():  # closer together than single precision tells
        s = product(x[many], p, ids[many])
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        more, cols = np.nonzero((s >= np.maximum(kth, least[many])[:, None] - _NEAR) & (s > -np.inf))
        r, c = np.r_[r[~many[r]], np.flatnonzero(many)[more]], np.r_[c[~many[r]], cols]
    # Row by row, so that equal vectors have equal scores wherever they stand.
    step = 16 * SLICE
    score = [np.einsum("ij,ij->i", x[r[i : i + step]], p[c[i : i + step]]) for i in range(0, len(r), step)]
    return r, keys[c], np.concatenate(score) if score else np.zeros(0)


def _compared(k: int, width: int, kinds: tuple[str, str]):
    """Pairs of a block of queries and one of points, whose components are of these kinds, to the k nearest of each query in that
    block of points."""
    unpacked = lambda raw, kind: _units(np.frombuffer(raw, kind).reshape(-1, width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in (at for b in batches for at in b.itertuples(index=False)):
            ids, keys = np.frombuffer(at.ids, np.int64), np.frombuffer(at.keys, np.int64)
            x, p = unpacked(at.x, kinds[0]), unpacked(at.points, kinds[1])
            x4, p4, all_least = x.astype("f4"), p.astype("f4"), np.frombuffer(at.least, float)
            wants = np.unpackbits(np.frombuffer(at.mask, np.uint8).reshape(math.ceil(len(ids) / SLICE), -1), axis=1).astype(bool)
            lists, own = np.frombuffer(at.lists, np.int32), np.isin(keys, ids)
            for i, want in enumerate(wants):
                rows = slice(i * SLICE, (i + 1) * SLICE)
                least, wanted, best = all_least[rows].copy(), np.flatnonzero(want[lists]), (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
                for j in range(0, len(wanted), 4 * SLICE):
                    cols = wanted[j : j + 4 * SLICE]
                    cols = slice(cols[0], cols[-1] + 1) if cols[-1] - cols[0] < len(cols) else cols
                    more = _candidates(x[rows], ids[rows], p[cols], keys[cols], (x4[rows], p4[cols]), np.flatnonzero(own[cols]), least, k)
                    if len(more[0]):
                        best = _ranked(*(np.concatenate(both) for both in zip(best, more, strict=True)), k)
                        full = np.flatnonzero(np.bincount(best[0], minlength=len(least)) == k)
                        kth = np.full(len(least), np.inf)
                        np.minimum.at(kth, best[0], best[2])
                        least[full] = np.maximum(least[full], kth[full])
                if len(best[0]):
                    yield pd.DataFrame({"query_id": ids[rows][best[0]], "key": best[1], "score": best[2]})

    return run


def _few_copies(keys: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k + 1 equal vectors of smaller keys precede: no query has them among its k nearest."""
    order = np.argsort(keys, kind="stable")
    if len(np.unique(keys)) < len(keys):
        return order
    same = np.unique(x[order] + 0.0, axis=0, return_inverse=True)[1].ravel()
    return order[np.sort(_ranked(same, np.arange(len(same)), np.zeros(len(same)), k + 1)[1])]


def nearest(points: DataFrame, queries: DataFrame | None, k: int, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, centres: np.ndarray | None = None) -> DataFrame:
    """query_id, key, score, rank: the k points with the largest cosine for each query(query_id, query), without the one of its own
    id; ties by key. Without queries the points are the queries. The zero vector has cosine 0 with all. Ids and vectors are not null."""
    spark = points.sparkSession
    shared_folder(spark)
    held = fit(points, key, vector) if centres is None else centres
    if not len(held):
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    probes = max(1, math.ceil(len(held) / 10)) if probes is None else probes
    width = held.shape[1]

    def typed(df: DataFrame, i: str, v: str) -> DataFrame:
        return df.select(F.col(i).cast("long").alias("key"), F.col(v).cast("array<float>" if df.schema[v].dataType.simpleString() == "array<float>" else "array<double>").alias("vector"))

    def assigned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                own, angle = _lists(_units(p["vector"]), held)
                yield p.assign(list=own, angle=angle)

    def in_lists(df: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
        """The rows with their list and place, and for each list where its rows begin, how many there are and its radius."""
        rows = df.mapInPandas(assigned, f"key long, vector {df.schema['vector'].dataType.simpleString()}, list int, angle double").checkpoint()
        found = rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas().set_index("list")  # one row a centre
        spans = found.reindex(range(len(held))).fillna({"radius": -1.0, "n": 0}).astype({"n": "int64"})
        spans["start"] = spans["n"].cumsum() - spans["n"]
        known = spark.createDataFrame([(int(c), int(r.start), int(r.n)) for c, r in zip(spans.index, spans.itertuples(), strict=True)], "list int, start long, n long")
        place = F.col("start") + F.pmod(F.xxhash64("key"), F.col("n"))
        return rows.join(F.broadcast(known), "list").withColumn("place", place), spans

    def in_blocks(df: DataFrame, spans: pd.DataFrame, share: int) -> tuple[DataFrame, int, int]:
        """The rows with their block, the rows of a block and the number of blocks."""
        part = max(1, min(PART, PART_BYTES // (width * np.dtype(kind(df)).itemsize)) // share)
        return df.withColumn("block", F.floor(F.col("place") / part).cast("int")), part, max(1, math.ceil(spans["n"].sum() / part))

    def pack_points(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("list", kind="stable")
        x, keys = np.array(list(g["vector"]), kinds[1]), g["key"].to_numpy()
        kept = _few_copies(keys, _units(x), k)
        return pd.DataFrame({"at": g["block"].iloc[:1].to_numpy(), "keys": [keys[kept].tobytes()], "points": [x[kept].tobytes()], "lists": [g["list"].to_numpy(np.int32)[kept].tobytes()]})

    def pack_queries(first: bool):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("list", kind="stable")  # a slice holds rows of few lists
            x, short = np.array(list(g["vector"]), kinds[0]), g["found"].to_numpy() < k
            least, visited = np.where(short, -np.inf, g["least"].to_numpy(float)), np.zeros((math.ceil(len(g) / SLICE), len(held)), bool)
            reach = np.where(short, np.pi, np.arccos(np.clip(least, -1, 1)))
            for i in range(0, len(g), SLICE):
                angle = _angles(_units(x[i : i + SLICE]), held)
                if first:
                    visited[i // SLICE, np.r_[g["list"].iloc[i : i + SLICE].unique(), angle.sum(0).argsort(kind="stable")[:probes]]] = True
                else:  # the angle to anything in the list is at least the one to its centre less the radius
                    visited[i // SLICE] = (angle - radius[None, :] <= reach[i : i + SLICE, None] + _SLACK).any(0)
            visited &= many > 0
            lists = np.flatnonzero(visited.any(0))
            wanted = sorted({int(b) for c in lists for b in range(start[c] // part, (start[c] + many[c] - 1) // part + 1)})
            return pd.DataFrame({"block": g["block"].iloc[:1].to_numpy(), "ids": [g["key"].to_numpy().tobytes()], "x": [x.tobytes()], "least": [least.tobytes()], "mask": [np.packbits(visited, axis=1).tobytes()], "wanted": [wanted]})

        return run

    kind = lambda df: "f4" if "float" in df.schema["vector"].dataType.simpleString() else "f8"
    points = typed(points, key, vector)
    asked = points if queries is None else typed(queries, "query_id", "query")
    kinds = kind(asked), kind(points)
    stored, spans = in_lists(points)
    radius, many, start = (spans[c].to_numpy() for c in ("radius", "n", "start"))
    blocks, part, n_points = in_blocks(stored, spans, 1)
    blocks = blocks.groupBy("block").applyInPandas(pack_points, "at int, keys binary, points binary, lists binary").repartitionById(n_points, "at")
    asked, _, n_queries = in_blocks(*((stored, spans) if queries is None else in_lists(asked)), 2)

    def matched(bounded: DataFrame, first: bool) -> DataFrame:
        sent = bounded.groupBy("block").applyInPandas(pack_queries(first), "block int, ids binary, x binary, least binary, mask binary, wanted array<int>").repartitionById(n_queries, "block")
        pairs = sent.hint("shuffle_replicate_nl").join(blocks, F.array_contains("wanted", F.col("at"))).drop("wanted", "at")
        return pairs.mapInPandas(_compared(k, width, kinds), "query_id long, key long, score double")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bound = best(matched(asked.withColumns({"found": F.lit(0).cast("long"), "least": F.lit(0.0)}), True)).groupBy(F.col("query_id").alias("key")).agg(F.count("*").alias("found"), F.min("score").alias("least"))
    rest = asked.join(bound, "key", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return best(matched(rest, False)).withColumnRenamed("key", key)


def neighbour_graph(points: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """source, target, score: an edge from each point to each of its k nearest."""
    return nearest(points, None, k, key, vector).select(F.col("query_id").alias("source"), F.col(key).alias("target"), "score")
