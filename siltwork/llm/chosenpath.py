"""N-gram Jaccard join by chosen paths: near-duplicate documents over sets of five-word shingles.

1. Documents with equal shingle sets are one node (their first row stands for all).
2. A node has a sketch of ``TOKENS`` tokens (minhashes). From the root of each of ``runs`` independent runs,
   a path goes on by each token that a hash of (path, token) samples, so that similar sets share paths.
   The sets that share a path of ``DEPTH`` tokens form a bucket. Small buckets are compared by brute force
   on sketches; large ones are split recursively by more sampled tokens, and what does not split (sets that
   are nearly the same) becomes one candidate group.
3. Buckets give candidate links; their connected components are candidate groups, which a chosen bound on
   the sketches keeps loose. Runs repeat until ``recall`` is reached for a pair at the threshold.
4. Inside each candidate group, all pairs are compared exactly on whole shingle sets, in blocks where the
   group is large. So every link of a group counts, whichever paths found the group.

No step emits the pairs of a group: buckets and groups give one link per member and a count.

Words are runs of characters other than white space, in lower case. A text of one to four words is one
shingle. Defined results: a null text or one without words has no links, and is its own class (null
doc_ids too have the class of what they match, or null); repeated rows count as copies; ties of the
smallest doc_id are one class; texts of any length are read whole; other columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltwork.llm.batches import Points, mix, ngrams, sliced
from siltwork.sources.session import shared_folder

SCHEMA = "doc_id long, class_id long, n_links long, n_copies long"
SHINGLE = 5
TOKENS, DEPTH, DEEPER, DEEPEST = 64, 3, 3, 9
#: A token goes on with probability 1 / (RATE * TOKENS).
RATE = 0.8
#: Buckets up to this size are compared by brute force; blocks of groups have this size at most.
BUCKET, BLOCK = 512, 1024
#: Up to so many members of candidate groups, their ids are broadcast to the second reading of the texts; beyond, they are joined by shuffle.
BROADCAST_MEMBERS = 1_000_000
#: Up to so many large buckets, their sizes are broadcast; beyond, paths are joined with them under so many salts.
BROADCAST_PATHS, SALTS = 500_000, 64
#: Narrow rows are read in tasks of so many, or one for each core: steps are many, and the driver holds figures of each task.
ROWS_A_TASK = 50_000

_A = mix(np.arange(1, TOKENS + 1, dtype=np.uint64))
_B = mix(np.arange(1001, TOKENS + 1001, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index): the distinct shingles of each text, by text and hash."""
    at = Points([t.lower() if t else t for t in texts])
    starts, ends, owner = at.words()
    words = at.hashes(starts, ends)
    grams, begin = ngrams(words, owner, SHINGLE)
    whose = owner[begin]
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = np.array([np.bitwise_xor.reduce(mix(words[f : f + count[s]] * np.uint64(2 * SHINGLE + 1) + np.arange(count[s], dtype=np.uint64))) for f, s in zip(first, short, strict=True)], np.uint64)
        grams, whose = np.concatenate([grams, mix(whole)]), np.concatenate([whose, short])
    order = np.lexsort((grams, whose))
    grams, whose = grams[order], whose[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (whose[1:] != whose[:-1])
    return grams[new], whose[new]


def sketches(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The tokens of each set: 16 bits of its minimum under each hash function."""
    out = np.zeros((len(starts), TOKENS), np.uint16)
    if len(starts):
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat(((grams ^ _A[k]) * _B[k]) >> np.uint64(24), starts) & np.uint64(0xFFFF)
    return out


def extend(paths: np.ndarray, owner: np.ndarray, tokens: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths that go on by ``levels`` sampled tokens of their sets, and whose they are."""
    limit = np.uint64(int(2.0**64 / (RATE * TOKENS)))
    own = mix(tokens.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))
    for _ in range(levels):
        h = mix(paths[:, None] ^ own[owner])
        k, token = np.nonzero(h < limit)
        paths, owner = mix(h[k, token] + np.uint64(1)), owner[k]
    return paths, owner


def runs_for(recall: float, similarity: float, levels: int = DEPTH) -> int:
    """Runs after which a pair of that similarity shares a path with probability ``recall``: shared paths branch by a Poisson law."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(-similarity / RATE * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def grouped(batches, key: int = 0) -> Iterator[pa.Table]:
    """The groups of rows with one key, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def joined(close: np.ndarray) -> np.ndarray:
    """The least index of the connected component of each row of a symmetric matrix of links."""
    label = np.arange(len(close))
    while True:
        least = np.where(close, label[None, :], len(close)).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _written(df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """The checkpointed rows, and what the job that writes them counts on the way."""
    seen = Observation()
    out = df.observe(seen, *[column.alias(name) for name, column in what.items()]).checkpoint()
    return out, seen.get


def _few(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more tasks than so many rows need, without a shuffle."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK)))


def _counted(paths: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """The paths with the size ``n`` of their bucket, and the number of large buckets. Large buckets' sizes are broadcast, or joined by salted paths beyond a bound, so that no task gets a whole large bucket."""
    sizes, seen = _written(sizes, n=F.count("*"), n_large=F.count_if(F.col("n") > BUCKET))
    sizes, n_large = _few(sizes, seen["n"]), seen["n_large"]
    large = sizes.where(F.col("n") > BUCKET).select("path", F.col("n").alias("n_large"))
    if not n_large:
        return paths.join(sizes, "path"), 0
    if n_large <= BROADCAST_PATHS:
        marked = paths.join(F.broadcast(large), "path", "left")
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        marked = paths.withColumn("salt", salt).join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["path", "salt"], "left").drop("salt")
    few = marked.where("n_large is null").select("path", "row").join(sizes.where(F.col("n") <= BUCKET), "path").select("path", "row", "n")
    return marked.where("n_large is not null").select("path", "row", F.col("n_large").alias("n")).unionByName(few), n_large


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.uint16) for b in column.to_pylist()])


def _compare_bucket(batches, floor: float):
    """Rows (path, row, sketch) of small buckets -> a link of each member to the first of those it resembles."""
    rows_out, to_out = [], []
    for g in grouped(batches):
        rows, order = np.unique(g.column(1).to_numpy(), return_index=True)
        if len(rows) < 2:
            continue
        s = _matrix(g.column(2).combine_chunks())[order]
        same = np.zeros((len(rows), len(rows)), np.int16)
        for k in range(TOKENS):
            same += s[:, k][:, None] == s[:, k]
        root = joined(same >= floor * TOKENS)
        far = root != np.arange(len(rows))
        rows_out.append(rows[far])
        to_out.append(rows[root[far]])
        if len(rows_out) >= 256:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(rows_out), "b": np.concatenate(to_out)})
            rows_out, to_out = [], []
    if rows_out:
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(rows_out), "b": np.concatenate(to_out)})


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root: the least node of each connected component of the links (a, b); alternating large and small stars."""
    tally = {"n": F.count("*"), "hash": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, now = _written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), **tally)  # what makes the links runs once
    last = None
    for _ in range(most_rounds):
        n = 2 * now["n"]  # no step has more rows
        both = _few(edges, n).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _few(_few(large, n).distinct(), n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges, now = _written(_few(_few(small.where("a != b"), n).distinct(), n), **tally)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _compare_group(batches):
    """Rows (part, half, row, shingles) -> (row, links, root): exact comparison of a small group (half 0), or of two blocks of a large one."""
    for g in grouped(batches):
        rows, first = np.unique(g.column(2).to_numpy(), return_index=True)
        half = g.column(1).to_numpy()[first]
        shingle = g.column(3)
        sets = [np.frombuffer(shingle[int(k)].as_py(), np.uint64) for k in first]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # Shingles of one member only take no part in an intersection.
        _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        kept = count[where] > 1
        column, owner = number[where[kept]], owner[kept]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        total = int((count > 1).sum())
        for a in range(0, total, width):
            i, j = np.searchsorted(column, [a, a + width])
            x = np.zeros((len(sets), min(width, total - a)), np.float32)
            x[owner[i:j], column[i:j] - a] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        # |A & B| / |A or B| >= 4/5
        close = 9 * both >= 4 * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(close, False)
        if half.any():
            close &= half[:, None] != half[None, :]
        links = close.sum(1)
        root = joined(close)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(links.astype(np.int64)), pa.array(rows[root])], names=["row", "links", "root"])


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: class_id (the least doc_id of its connected component of links and copies), n_links (other
    shingle sets that it resembles by at least 4/5), n_copies (other documents with its own set)."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "n_copies")


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with one row of each class: the one of the least doc_id. Rows without words stay."""
    all_rows, seen = _written(classes(docs, **options).where("root is not null").select("row", "doc_id", "root"), n=F.count("*"))
    all_rows = _few(all_rows, seen["n"])
    first = all_rows.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    gone, seen = _written(all_rows.select("row").join(first, "row", "left_anti").select(F.col("row").alias("__gone")), n=F.count("*"))
    gone = F.broadcast(_few(gone, seen["n"])) if seen["n"] <= BROADCAST_MEMBERS else gone
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    kept = docs.withColumn("__row", number(docs[id_column].cast("long"), docs[text_column])).join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    again, seen = _written(all_rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("__again")), n=F.count("*"))
    if not seen["n"]:
        return kept.drop("__row")
    # Of rows repeated under one doc_id with one text, each task sends one on.
    match = F.col("__row") == F.col("__again")
    once = kept.join(again, match, "left_semi").groupBy("__row", F.xxhash64(docs[text_column], docs[id_column].cast("long"))).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.join(again, match, "left_anti").drop("__row").unionByName(once)


def number(doc_id, text):
    """A document's number in all readings: a hash of its id and text, so rows that repeat both share it."""
    return F.xxhash64(doc_id, text)


def classes(docs: DataFrame, recall: float = 0.9999, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row (the document's number), root (a row that stands for its class, null without words), class_id, n_links, n_copies."""
    shared_folder(docs.sparkSession)
    runs = runs_for(recall, similarity)
    floor = similarity - 4 * math.sqrt(similarity * (1 - similarity) / TOKENS)
    src = docs.select(docs[id_column].cast("long").alias("doc_id"), number(docs[id_column].cast("long"), docs[text_column]).alias("row"), docs[text_column].alias("text"))

    def sketch(batches):
        for part, texts in sliced(batches, "text"):
            grams, owner = shingles(texts)
            full, starts, n = np.unique(owner, return_index=True, return_counts=True)
            m = len(texts)
            size, low, high, tokens = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), [None] * m
            if len(full):
                size[full] = n
                low[full] = np.add.reduceat(mix(grams), starts).view(np.int64)
                high[full] = np.bitwise_xor.reduceat(mix(grams + np.uint64(7)), starts).view(np.int64)
                for i, s in zip(full, sketches(grams, starts), strict=True):
                    tokens[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(size), pa.array(low), pa.array(high), pa.array(tokens, pa.binary())],
                names=["doc_id", "row", "size", "low", "high", "sketch"],
            )

    nodes = src.mapInArrow(sketch, "doc_id long, row long, size long, low long, high long, sketch binary").checkpoint()
    key = ["size", "low", "high"]
    full = nodes.where("size > 0")
    sets = full.groupBy(*key).agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    sets, seen = _written(sets, n=F.count("*"))
    n_sets = seen["n"]
    sets = _few(sets, n_sets)
    own = sets.select("row").join(full.select("row", "sketch"), "row").dropDuplicates(["row"]).checkpoint()

    def start(batches):
        for batch in batches:
            if batch.num_rows:
                tokens, rows = _matrix(batch.column(1)), batch.column(0).to_numpy()
                for a in range(0, len(rows), 1024):
                    t = tokens[a : a + 1024]
                    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
                    paths, owner = extend(np.tile(roots, len(t)), np.repeat(np.arange(len(t)), runs), t, DEPTH)
                    yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(rows[a : a + 1024][owner])], names=["path", "row"])

    def go_on(batches):
        for batch in batches:
            if batch.num_rows:
                paths, owner = extend(batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows), _matrix(batch.column(2)), DEEPER)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column(1).take(pa.array(owner))], names=["path", "row"])

    paths = own.mapInArrow(start, "path long, row long")
    links, depth = None, DEPTH
    while True:
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        live, n_large = _counted(paths, sizes)
        live, seen = _written(live.join(_few(own, n_sets), "row").select("path", "row", "sketch", "n"), n=F.count("*"))
        live = _few(live, seen["n"])
        last = depth >= DEEPEST
        small = live.where(F.col("n") <= BUCKET).select("path", "row", "sketch")
        found = small.repartition("path").sortWithinPartitions("path").mapInArrow(lambda b: _compare_bucket(b, floor), "a long, b long").distinct()
        links = found if links is None else links.unionByName(found)
        large = live.where(F.col("n") > BUCKET)
        if last:  # what shares so many sampled tokens is one candidate group
            least = large.groupBy("path").agg(F.min("row").alias("b"))
            links = links.unionByName(large.select(F.col("row").alias("a"), "path").join(F.broadcast(least) if n_large <= BROADCAST_PATHS else least, "path").select("a", "b").distinct())
        if last or not n_large:
            break
        paths, seen = _written(large.select("path", "row", "sketch").mapInArrow(go_on, "path long, row long"), n=F.count("*"))
        paths = _few(paths, seen["n"])
        depth += DEEPER
    member = components(links)
    member = member.unionByName(member.select(F.col("root").alias("node"), "root").distinct())
    counts = member.groupBy("root").agg(F.count("*").alias("n"))
    member, seen = _written(member.join(counts, "root").select(F.col("node").alias("row"), "root", "n"), n=F.count("*"))

    def exact(batches):
        seen: set[int] = set()  # of rows that repeat, a task sends the first
        for part, texts in sliced(batches, "text"):
            new = [k for k, r in enumerate(part.column(0).to_pylist()) if not (r in seen or seen.add(r))]
            part, texts = part.take(pa.array(new, pa.int64())), [texts[k] for k in new]
            grams, owner = shingles(texts)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([grams[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                names=["row", "root", "n", "shingles"],
            )

    side = F.broadcast(_few(member, seen["n"])) if seen["n"] <= BROADCAST_MEMBERS else member
    texts = src.select("row", "text").join(side, "row").select("row", "root", "n", "text")
    whole = texts.mapInArrow(exact, "row long, root long, n long, shingles binary")
    # A large group is dealt to blocks; each pair of blocks meets in one part. half: which of the two blocks a member is of, 0 for all pairs.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    parts = whole.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select(
        F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("half"), "row", "shingles",
    )
    compared, seen = _written(parts.repartition("part").sortWithinPartitions("part").mapInArrow(_compare_group, "row long, links long, root long"), n=F.count("*"))
    compared = _few(compared, seen["n"])
    linked = compared.groupBy("row").agg(F.sum("links").alias("links"))
    group = components(compared.where("row != root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    sets = sets.join(linked, "row", "left").join(group, F.col("row") == F.col("node"), "left").select(*key, "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "row").alias("root"))
    least = sets.groupBy("root").agg(F.min("first_id").alias("class_id"))
    sets = sets.join(least, "root").select(*key, "root", "class_id", "links", "copies")
    return nodes.select("doc_id", "row", *key).join(sets, key, "left").select(
        "doc_id", "row", "root", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), (F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_copies"),
    )
