"""Vector search: exact cosine top-k, exact symbols, merged results; embedding with deduplication and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.functions.checks import InvalidRows, holds
from siltwork.sources.session import shared_folder

TOP, MOST = 15, 50
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: Queries beyond so many are scored in blocks, each against all points.
QUERY_BLOCK = 256


def _limit(k: int) -> int:
    if not 0 < k <= MOST:
        raise ValueError(f"a limit is between 1 and {MOST}")
    return k


def scores(points: DataFrame, held: pd.DataFrame, key: str = "vec_id", vector: str = "embedding", k: int | None = None, at_least: float | None = None, slack: float = 0.0) -> DataFrame:
    """query_id, key, score of each held query with each point: one matrix product a batch in the tasks that read points.

    With ``k`` or ``at_least`` only what can still be among the k best, or at the bound, leaves the task: of a batch, the
    points within ``slack`` of a query's k-th best score (of equal scores the k least keys), and those within it of the bound."""
    ids, q = held["query_id"].to_numpy(), np.array(held["query"].tolist(), float).reshape(len(held), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(held) else q

    def best(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of one query's scores that may be among its k best."""
        rows = np.flatnonzero(~(s < np.partition(s, len(s) - k)[len(s) - k] - slack)) if len(s) > k else np.arange(len(s))
        rows = rows[np.lexsort((keys[rows], -s[rows]))]
        starts = np.flatnonzero(np.r_[True, np.diff(s[rows]) != 0])
        return rows[np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(ids):
                p, keys = np.array(b[vector].tolist(), float), b[key].to_numpy()
                n = np.linalg.norm(p, axis=1)
                s = (p @ q.T) / np.where(n == 0, 1.0, n)[:, None]
                if k is not None:
                    kept = [best(s[:, j], keys) for j in range(len(ids))]
                    rows, cols = np.concatenate(kept), np.repeat(np.arange(len(ids)), [len(r) for r in kept])
                else:
                    rows, cols = np.nonzero(~(s < (-np.inf if at_least is None else at_least - slack)))
                yield pd.DataFrame({"query_id": ids[cols], key: keys[rows], "score": s[rows, cols]})

    return points.select(key, vector).mapInPandas(run, f"query_id long, {key} long, score double")


def top_k(points: DataFrame, queries: DataFrame, k: int | None = TOP, at_least: float | None = None, key: str = "vec_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """The k best points of each query(query_id, query), ties by key. Queries are taken in blocks of ``QUERY_BLOCK``, each held by
    every task against all points, so points are not shuffled; of a query, about k rows leave each batch of points."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    dealt = queries.select("query_id", "query").withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    slack = 0.0 if places is None else 10.0**-places  # what rounding may move
    most = None if k is None else _limit(k)
    parts = [scores(points, dealt.where(F.col("__b") == b).orderBy("query_id").drop("__b").toPandas(), key, vector, most, at_least, slack) for b in range(blocks)]
    s = parts[0]
    for other in parts[1:]:
        s = s.unionByName(other)
    s = s if places is None else s.withColumn("score", F.round("score", places))
    s = s if at_least is None else s.where(F.col("score") >= at_least)
    ranked = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either is the zero vector."""
    n = X.norm(a) * X.norm(b)
    return F.when(n == 0, 0.0).otherwise(X.dot(a, b) / n)


def nearest(points: DataFrame, query: list[float], k: int = TOP, at_least: float | None = None, vector: str = "embedding") -> DataFrame:
    """The k best points for one vector, by one pass and a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = points.withColumn("score", similarity(F.col(vector), q))
    return (s if at_least is None else s.where(F.col("score") >= at_least)).orderBy(F.desc("score"), "id").limit(_limit(k))


def exact_symbol(points: DataFrame, name: str, k: int = TOP) -> DataFrame:
    """Definitions (score 1), then uses in references, imports and exports (0.95). Each is limited in the order of ids before the ranking."""
    defined = points.where(F.col("symbol_name") == name).orderBy("id").limit(_limit(k)).withColumn("score", F.lit(1.0))
    used = points.where(F.array_contains("references", name) | F.array_contains("imports", name) | F.array_contains("exports", name)).orderBy("id").limit(k).withColumn("score", F.lit(0.95))
    both = defined.unionByName(used.join(defined.select("id"), "id", "left_anti"))
    return both.orderBy(F.desc("score"), "file_path", "start_line", "chunk_index").limit(k)


def merge(exact: DataFrame, semantic: DataFrame, key: list[str], k: int = TOP) -> DataFrame:
    """Exact results first, all with score 1, then semantic ones that are not among them; each side has ``rank``. First k a query."""
    *by, item = key
    both = exact.select(*key, F.lit(1.0).alias("score"), F.lit(0).alias("part"), "rank").unionByName(semantic.select(*key, "score", F.lit(1).alias("part"), "rank"))
    best = both.groupBy(*key).agg(F.min_by(F.struct("score", "part", "rank"), F.struct("part", "rank")).alias("b")).select(*key, "b.*")
    order = W.partitionBy(*by).orderBy("part", "rank")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("part")


# -- embedding --

BATCH, TOKENS = 50, 290_000


def _borders(sizes: np.ndarray, most: int, budget: int) -> np.ndarray:
    """For each input the one that begins the next batch if this one begins a batch; the number of inputs where none does."""
    total = np.cumsum(sizes)
    full = np.searchsorted(total, total - sizes + budget, side="right")
    place = np.arange(len(sizes))
    return np.minimum(np.maximum(np.minimum(full, place + most), place + 1), len(sizes))


def _changes(keys: pd.DataFrame, before: pd.DataFrame | None | bool = True) -> np.ndarray:
    """Where a row's key differs from the row before it. ``before``: the row ahead of the first; True: the first is a change, None: it is none."""
    if before is None or before is True:
        out = _changes(keys.iloc[1:], keys.iloc[:1]) if len(keys) > 1 else np.zeros(0, bool)
        return np.append(np.full(min(1, len(keys)), before is True), out)
    both = pd.concat([before, keys])
    last = both.shift()
    return ((both != last) & ~(both.isna() & last.isna())).any(axis=1).to_numpy()[1:]


def _run_summary(sizes: np.ndarray, most: int, budget: int, begins: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """The first inputs' sizes, and for a batch that begins with each of the first ``begins`` inputs: how many batches begin up to the run's
    end, and the inputs and tokens of the last. Borders are followed by pointer doubling, so each round goes twice as far."""
    n, total = len(sizes), np.cumsum(sizes)
    after = np.append(_borders(sizes, most, budget), n)
    count = np.append(np.ones(n, np.int64), 0)
    last = np.append(np.arange(n), n)
    while (after < n).any():
        count += count[after]
        last = np.where(after < n, last[after], last)
        after = after[after]
    at = last[: min(begins, n)]
    return sizes[:most].tolist(), count[: len(at)].tolist(), (n - at).tolist(), (total[-1] - total[at] + sizes[at]).tolist()


def batches(sizes: DataFrame, key: list[str], order: str, tokens: str, most: int = BATCH, budget: int = TOKENS) -> DataFrame:
    """Adds ``batch``: inputs in order go into one batch until it has ``most`` or would pass the budget; each key is a queue of its own.

    Rows are dealt by ranges of (key, order), so one queue spreads over all tasks. A first pass sums up how each partition's first
    run takes a batch that begins in it (``most`` ways at most) and how its last run ends; the runs of a key are put together from
    these, a row for each partition; the second pass numbers the batches from the batch that each partition finds open."""
    shared_folder(sizes.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema)
    kinds = ", ".join(f"`k{n}` {dict(sizes.dtypes)[k]}" for n, k in enumerate(key))
    slots = [f"k{n}" for n in range(len(key))]
    laid = sizes.repartitionByRange(*key, order).sortWithinPartitions(*key, order).checkpoint()  # both passes see the same partitions

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs = TaskContext.get().partitionId(), []  # (key, sizes by frame) of the first run and of the latest
        for df in parts:
            cut, sizes_ = np.flatnonzero(_changes(df[slots])), df["t"].to_numpy(np.int64)
            for a, b in zip(cut, [*cut[1:], len(df)], strict=True):
                own = tuple(None if pd.isna(v) else v for v in df[slots].iloc[a])
                if runs and runs[-1][0] == own:
                    runs[-1][1].append(sizes_[a:b])
                else:
                    runs = [*runs[:1], (own, [sizes_[a:b]])]
        rows = [(*k, part, len(s := np.concatenate(own)), int(s.sum()), *_run_summary(s, most, budget, 1 if n else most)) for n, (k, own) in enumerate(runs)]
        yield pd.DataFrame(rows, columns=[*slots, "part", "n", "total", "head", "batches", "open_n", "open_total"])

    def chained(runs: pd.DataFrame) -> pd.DataFrame:
        n = total = batch = 0  # of the batch that is open: its inputs and tokens, its number
        out = []
        for r in runs.sort_values("part").itertuples(index=False):
            out.append((r.part, n, total, batch))
            e, room = 0, total
            while e < r.n and e < len(r.head) and n and n + e < most and room + r.head[e] <= budget:
                room, e = room + int(r.head[e]), e + 1
            if e == r.n:  # the open batch takes the whole run
                n, total = n + e, room
                continue
            batch += int(r.batches[e]) - (0 if n else 1)
            n, total = int(r.open_n[e]), int(r.open_total[e])
        return pd.DataFrame(out[1:], columns=["part", "n", "total", "batch"])

    slim = laid.select(*[F.col(k).alias(n) for n, k in zip(slots, key, strict=True)], F.col(tokens).cast("long").alias("t"))
    runs = slim.mapInPandas(summed, f"{kinds}, part int, n long, total long, head array<long>, batches array<long>, open_n array<long>, open_total array<long>")
    found = runs.groupBy(*slots).applyInPandas(chained, "part int, n long, total long, batch long")
    carried = {r["part"]: (r["n"], r["total"], r["batch"]) for r in found.collect()}  # one row a partition at most

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, (n, total, batch) = None, carried.get(TaskContext.get().partitionId(), (0, 0, 0))
        for df in parts:  # rows of a key stand together in order, so only the open batch's counts are held
            out = []
            for new, t in zip(_changes(df[key], now), df[tokens].tolist(), strict=True):
                if new:
                    n, total, batch = 0, 0, 0
                if n >= most or (n and total + t > budget):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + t
                out.append(batch)
            now = df[key].iloc[-1:] if len(df) else now
            yield df.assign(batch=out)

    return laid.mapInPandas(numbered, f"{fields}, batch long")


def hashing_embedder(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic provider for tests: signed hashes of words."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h & 0x8000 else -1
    return out


def embed(inputs: DataFrame, provider: Callable[[list[str]], np.ndarray] = hashing_embedder, size: int = 64, most: int = BATCH, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """id, input_hash, embedding of all inputs: each different text is embedded once, in batches of at most ``most``; joined back by hash."""
    keyed = inputs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("input_hash", X.sha256("text"))
    texts = keyed.groupBy("input_hash").agg(F.min("text").alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), most):
                cut = part.iloc[a : a + most]
                v = np.asarray(provider(cut["text"].tolist()), np.float32)
                if v.shape != (len(cut), size) or not np.isfinite(v).all():
                    raise InvalidRows("the provider returned other vectors than asked for")
                yield pd.DataFrame({"input_hash": cut["input_hash"].to_numpy(), "embedding": list(v)})

    vectors = texts.mapInPandas(run, "input_hash string, embedding array<float>")
    return keyed.select("id", "input_hash").join(vectors, "input_hash")


def place(vectors: DataFrame, responses: DataFrame, expected: int) -> DataFrame:
    """Vectors of a response by their index, which must be 0 to expected - 1, each once."""
    r = responses.agg(F.count("*").alias("n"), F.count_distinct("index").alias("d"), F.min("index").alias("a"), F.max("index").alias("b")).first()
    if (r["n"], r["d"], r["a"], r["b"]) != (expected, expected, 0, expected - 1):
        raise InvalidRows("the response's indices have gaps or repeats")
    return vectors.join(responses, "index")


def valid_points(points: DataFrame, size: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``error``: the first rule of stored points that a row breaks, or null. ``scope``: columns that are trimmed, not blank and without NUL;
    with them, ids that several points of the batch share are an error too."""
    safe = lambda c: (F.col(c) != "") & (X.trimmed(c) == F.col(c)) & ~F.col(c).contains("\0")
    rules = [("id", F.col("id").rlike(_UUID)), *[(c, safe(c)) for c in scope], ("content", X.trimmed("content") != ""), ("lines", (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))), ("hash", F.col("content_hash").rlike("^[0-9a-f]{64}$")), ("vector", X.finite_vector("embedding", size))]
    out = points.withColumn("error", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    if not scope:
        return out
    shared = points.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("__shared"))
    return out.join(shared, "id", "left").withColumn("error", F.coalesce("error", "__shared")).drop("__shared")


def valid_results(results: DataFrame, **scope: str) -> DataFrame:
    """Adds ``error``: the first rule of search results that a row breaks, or null: uuid, finite score, the scope asked for, lines, hash."""
    score = F.col("score")
    rules = [("id", F.col("id").rlike(_UUID)), ("score", ~F.isnan(score) & (F.abs(score) != float("inf")))]
    rules += [(name, F.col(name) == value) for name, value in scope.items()]
    rules += [("lines", (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))), ("hash", F.col("content_hash").rlike("^[0-9a-f]{64}$"))]
    return results.withColumn("error", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))


def checked_results(results: DataFrame, **scope: str) -> DataFrame:
    """The results, if all are valid: one that is not fails the query rather than being left out."""
    return holds(valid_results(results, **scope), F.col("error").isNull(), "an invalid search result").drop("error")


# -- requests to a provider --


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens by a tokenizer file, loaded where it is first used."""
    held: list = []

    def count(texts: list[str]) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
            held[0].no_truncation()
            held[0].no_padding()
            held[0].encode_special_tokens = True
        return [len(e.ids) for e in held[0].encode_batch_fast(texts, add_special_tokens=False)]

    return count


def embed_requests(inputs: DataFrame, provider: Callable[[list[str]], dict], counter: Callable[[list[str]], list[int]], size: int, most: int = BATCH, budget: int = TOKENS, id_column: str = "id", text_column: str = "text") -> dict[str, DataFrame]:
    """points(id, input_hash, embedding), usage(batch, inputs, tokens, model) and totals(requests, inputs, tokens, model).

    Each different text is sent once, in requests of at most ``most`` texts and ``budget`` tokens by ``counter``. provider(texts) gives
    {"vectors", "model", "tokens"}. Blank texts, texts with a NUL or over the budget, other vectors than asked for, and more
    than one model fail the run before any point is returned."""
    shared_folder(inputs.sparkSession)
    keyed = inputs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("input_hash", X.sha256("text"))
    sound = (X.trimmed("text") != "") & ~F.col("text").contains("\0")
    texts = holds(keyed, sound, "a blank text, or one with a NUL").groupBy("input_hash").agg(F.min("text").alias("text"))

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = counter(p["text"].tolist())
            if any(t > budget for t in n):
                raise InvalidRows("a text over the token budget")
            yield p.assign(tokens=np.array(n, np.int64))

    sized = texts.mapInPandas(counted, "input_hash string, text string, tokens long").withColumn("queue", F.lit("all"))
    dealt = batches(sized, ["queue"], "input_hash", "tokens", most, budget)

    def sent(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("input_hash")
        answer = provider(group["text"].tolist())
        v = np.asarray(answer["vectors"], np.float32)
        if v.shape != (len(group), size) or not np.isfinite(v).all():
            raise InvalidRows("the provider returned other vectors than asked for")
        used = np.zeros(len(group), np.int64)
        used[0] = int(answer["tokens"])
        return pd.DataFrame({"batch": group["batch"].to_numpy(), "input_hash": group["input_hash"].to_numpy(), "embedding": list(v), "model": answer["model"], "used": used})

    answers = dealt.groupBy("batch").applyInPandas(sent, "batch long, input_hash string, embedding array<float>, model string, used long").checkpoint()  # a provider is not asked twice
    usage = answers.groupBy("batch").agg(F.count("*").alias("inputs"), F.sum("used").alias("tokens"), F.max("model").alias("model"))
    totals = answers.agg(F.count_distinct("batch").alias("requests"), F.count("*").alias("inputs"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count_distinct("model").alias("models"), F.max("model").alias("model"))
    if totals.first()["models"] > 1:
        raise InvalidRows("the provider used more than one model")
    points = keyed.select("id", "input_hash").join(answers.select("input_hash", "embedding"), "input_hash").select("id", "input_hash", "embedding")
    return {"points": points, "usage": usage, "totals": totals.drop("models")}
