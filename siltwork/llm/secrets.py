"""Secret scans: fixed patterns, plus a linear-chain conditional random field over the tokens of the whole text.

Tokens are runs of letters, digits and ``+/_-.``; a token's label is O (outside), B (a secret begins) or
I (it goes on). Features are the token's shape, the identities (hashed, lower case) of the two words before and the one
after it, what separates it from the word before, and features of the file. The field is trained by gradient steps
on the exact log-likelihood of windows from at most ``sample`` documents, at most ``windows_per_document`` of each
(the documented bounds of its sample), labelled by the fixed patterns. So that it finds more than these: in variants of
the texts the secrets have other letters and digits, or a secret is put in, and words are joined to compounds that are none; and
half of the windows come again with their neighbouring words hidden. The field then tags all tokens of all documents by Viterbi.

Defined results: a null or empty text has no span; texts of any length are read whole; repeated rows are scanned each
on its own; overlapping spans of different kinds are all kept; the field only adds spans that meet no pattern's span;
other columns are not read; an empty table gives an empty table, and a field that tags nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.batches import Points, sliced
from siltwork.llm.viterbi import decode

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"
SPAN_SCHEMA = "doc_id long, kind string, start long, end long, secret string"

#: Fixed patterns of the base kinds, in the order in which kinds at one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "tagged"]
_HINTS = ("password", "passwd", "secret", "token", "api")

_OUT, _BEGIN, _IN = 0, 1, 2

#: Bytes of text tagged at once: some fifteen arrays of eight bytes each stand beside them.
_SLICE = 250_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base spans, sorted."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A maximal run of [0-9a-f] of under 16 characters fails and is dropped; this pattern passes over it.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _alphabet() -> np.ndarray:
    """Bits of each code point below 128: 1 in tokens, 2 digit, 4 upper, 8 lower, 16 hex digit, 32 assigns, 64 quotes, 128 code."""
    bits = np.zeros(129, np.uint8)
    for c in range(128):
        s = chr(c)
        bits[c] = (s.isalnum() or s in "+/_-.") | (s.isdigit() << 1) | (s.isupper() << 2) | (s.islower() << 3) | ((s in "0123456789abcdef") << 4) | ((s in "=:") << 5) | ((s in "\"'`") << 6) | ((s in "{}()[];<>=") << 7)
    return bits


_BITS = _alphabet()
#: The number of values of each feature, in order.
WORDS = 1024
SIZES = [8, 6, 6, 6, 3, 3, 3, 5, 25, 8, 4, 4, WORDS + 1, WORDS + 1, WORDS + 1]
#: The features that are words; 0 is no word, or a hidden one.
_WORD_FEATURES = slice(12, 15)


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    features: np.ndarray


def tokenize(texts: list) -> Tokens:
    """The tokens of the texts with the values of their features, all in numpy."""
    at = Points(texts)
    p = at.points
    bits = _BITS[np.minimum(p, 128)]
    starts, ends = at.runs((bits & 1 > 0) | (p >= 0xC0))
    owner = np.searchsorted(at.ends, starts, side="right")
    n = len(starts)

    def within(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
        return total[b] - total[a]

    length = ends - starts
    digit, upper, lower, hexes = (within(bits & b > 0, starts, ends) for b in (2, 4, 8, 16))
    wide = within(p >= 128, starts, ends)
    share = lambda x: np.where(x == 0, 0, np.where(x == length, 5, 1 + np.minimum(4 * x // np.maximum(length, 1), 3)))
    before = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if n else starts
    before = np.where(owner == np.concatenate([[-1], owner[:-1]]), before, at.starts[owner]) if n else starts
    gap_assign, gap_quote = within(bits & 32 > 0, before, starts), within(bits & 64 > 0, before, starts)
    size = np.searchsorted([4, 8, 12, 16, 20, 32, 44], length, side="right")
    changes = np.zeros(len(p), bool)
    if len(p):
        kind = np.where(bits & 2 > 0, 1, np.where(bits & 4 > 0, 2, np.where(bits & 8 > 0, 3, 4)))
        changes[1:] = kind[1:] != kind[:-1]
    sort = np.where(bits & 2 > 0, 1, np.where(bits & 4 > 0, 2, np.where(bits & 8 > 0, 3, np.where(p >= 128, 4, 0))))
    edges = 5 * sort[starts] + sort[ends - 1] if n else starts
    mixing = np.minimum(within(changes, np.minimum(starts + 1, ends), ends), 8) // 2
    small = Points([t.lower() if t and len(t.lower()) == len(t) else t for t in texts])
    word = (small.hashes(starts, ends) % np.uint64(WORDS)).astype(np.int16) + np.int16(1)
    shift = lambda x, k: np.concatenate([np.zeros(min(k, n), x.dtype), x[:-k]]) if k > 0 else np.concatenate([x[-k:], np.zeros(min(-k, n), x.dtype)])
    same = lambda k: shift(owner + 1, k) == owner + 1
    code = np.bincount(np.searchsorted(at.ends, np.flatnonzero(bits & 128 > 0), side="right"), minlength=len(texts))
    digits = np.bincount(np.searchsorted(at.ends, np.flatnonzero(bits & 2 > 0), side="right"), minlength=len(texts))
    chars = np.maximum(at.ends - at.starts, 1)
    features = np.stack([
        size, share(digit), share(upper), share(lower), np.where(wide > 0, 2, np.where(hexes == length, 1, 0)),
        np.minimum(gap_assign, 2), np.minimum(gap_quote, 2), mixing,
        edges, np.where(same(-1), shift(size, -1), 0), np.searchsorted([1e-4, 1e-3, 1e-2], code / chars, side="right")[owner],
        np.searchsorted([1e-4, 1e-3, 1e-2], digits / chars, side="right")[owner],
        np.where(same(1), shift(word, 1), 0), np.where(same(2), shift(word, 2), 0), np.where(same(-1), shift(word, -1), 0),
    ]).astype(np.int16) if n else np.zeros((len(SIZES), 0), np.int16)
    return Tokens(starts, ends, owner, features)


def secret_spans(text: str) -> list[tuple[int, int]]:
    """What the field learns as secrets: the value of an assignment, and the other base kinds as they stand."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found + [(a, b) for a, kind, b in base_spans(text) if kind])


def labels(found: list[list[tuple[int, int]]], t: Tokens, starts: np.ndarray) -> np.ndarray:
    """B, I and O by the spans of each text. starts: of the texts, in tokens' points."""
    out = np.zeros(len(t.starts), np.int8)
    for i, spans_ in enumerate(found):
        for a, b in spans_:
            _mark(out, t, starts[i] + a, starts[i] + b)
    return out


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_secret(rng: random.Random) -> str:
    signs = rng.choice([_LETTERS, _LETTERS, _LETTERS + "_", _LETTERS + "-", _LETTERS + "+/", "0123456789abcdef", "0123456789"])
    return "".join(rng.choice(signs) for _ in range(rng.randint(16, 44 if len(signs) > 10 else 19)))


def other_secrets(text: str, found: list[tuple[int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with other secrets in place of those found, and where they stand."""
    out, spans_, at, size = [], [], 0, 0
    for a, b in found:
        if a >= at:
            new = made_secret(rng)
            out += [text[at:a], new]
            size += a - at
            spans_.append((size, size + len(new)))
            size += len(new)
            at = b
    return "".join([*out, text[at:]]), spans_


def compounds(text: str, rng: random.Random, most: int = 4) -> tuple[str, list[tuple[int, int]]]:
    """The text with some neighbouring words joined (with signs, as camel case), and numbers, dates and versions, which are
    no secrets; and with a secret, whose place comes back."""
    words = text.split(" ")
    if len(words) < 20:
        return text, []
    for _ in range(most):
        k, n = rng.randrange(len(words) - 4), rng.randint(2, 4)
        part, number = words[k : k + n], lambda x: str(rng.randrange(1, x))
        if all(w.isalpha() for w in part):
            words[k : k + n] = [rng.choice([
                lambda: rng.choice("-_/.").join(part), lambda: "".join(w.capitalize() for w in part), lambda: part[0] + number(3000), lambda: "".join(part).upper(),
                lambda: f"{number(3000)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00", lambda: f"{part[0]}-{number(9)}.{number(30)}.{number(99)}",
                lambda: f"{number(99)},{number(999)},{number(999)}.{number(99)}", lambda: f"https://{part[0]}.{part[1]}/{part[-1]}.html",
            ])()]
    k, new = rng.randrange(len(words)), made_secret(rng)
    start = sum(len(w) + 1 for w in words[:k])
    return " ".join([*words[:k], new, *words[k:]]), [(start, start + len(new))]


def _mark(out: np.ndarray, t: Tokens, a: int, b: int) -> None:
    inside = np.arange(np.searchsorted(t.ends, a, side="right"), np.searchsorted(t.starts, b))
    if len(inside) and not out[inside].any():
        out[inside] = _IN
        out[inside[0]] = _BEGIN


@dataclass
class Field:
    """weights[offset of the feature + its value, label] and the scores of label pairs."""

    weights: np.ndarray
    moves: np.ndarray

    def emit(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        at = 0
        for values, size in zip(features, SIZES, strict=True):
            out += self.weights[at : at + size][values]
            at += size
        return out


def train(windows: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 512, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Adagrad on the mean log-likelihood of batches, dealt anew when all windows were seen. windows: (n, length, features), tags: (n, length)."""
    _, length, kinds = windows.shape
    offsets = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    weights, moves = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    sums = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    rng, order = np.random.default_rng(1), np.zeros(0, np.int64)
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(len(windows))
        now, order = order[:batch], order[batch:]
        index, gold = windows[now].astype(np.int64) + offsets, tags[now]
        n = len(now)
        e = weights[index].sum(2)
        forward, backward = np.empty((length, n, 3)), np.zeros((length, n, 3))
        forward[0] = e[:, 0]
        for t in range(1, length):
            forward[t] = _lse(forward[t - 1][:, :, None] + moves, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            backward[t] = _lse(moves + (e[:, t + 1] + backward[t + 1])[:, None, :], 2)
        z = _lse(forward[-1], 1)
        # What is there less what the field expects: its gradient.
        missing = (gold[:, :, None] == np.arange(3)) - np.exp(forward + backward - z[None, :, None]).transpose(1, 0, 2)
        flat = index.reshape(-1)
        up = np.stack([np.bincount(flat, np.repeat(missing[:, :, l].reshape(-1), kinds), minlength=len(weights)) for l in range(3)], 1)
        up_moves = np.zeros((3, 3))
        np.add.at(up_moves, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
        for t in range(1, length):
            up_moves -= np.exp(forward[t - 1][:, :, None] + moves + (e[:, t] + backward[t])[:, None, :] - z[:, None, None]).sum(0)
        for value, change, total in ((weights, up / n - decay * weights, sums[0]), (moves, up_moves / n - decay * moves, sums[1])):
            total += change**2
            value += rate * change / np.sqrt(total)
    return Field(weights.astype(np.float32), moves.astype(np.float32))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


WINDOW = 17


def windows(texts: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, tags) of the training windows of some texts and their variants, at most ``most`` of each text."""
    found = [secret_spans(t or "") for t in texts]
    variants, more = [], []
    for t, f in zip(texts, found, strict=True):
        rng = random.Random(zlib.crc32((t or "").encode("utf-8", "surrogatepass")))
        new, spans_ = other_secrets(t, f, rng) if f else compounds(t or "", rng)
        variants.append(new)
        more.append(spans_)
    out = []
    for some, spans_ in ((texts, found), (variants, more)):
        t = tokenize(some)
        n = len(t.owner)
        tags = labels(spans_, t, Points(some).starts)
        first, count = np.searchsorted(t.owner, np.arange(len(some))), np.bincount(t.owner, minlength=len(some))
        # Where secrets begin; long tokens that are none, which teach most; the middle of each text.
        centres = np.concatenate([np.flatnonzero(tags == _BEGIN), np.flatnonzero((tags == _OUT) & (t.ends - t.starts >= 12)), first + count // 2])
        begin = np.clip(centres - WINDOW // 2, 0, max(n - WINDOW, 0))
        begin = begin[begin + WINDOW <= n]
        begin = np.unique(begin[t.owner[begin] == t.owner[begin + WINDOW - 1]])
        rank = np.arange(len(begin)) - np.searchsorted(t.owner[begin], t.owner[begin])
        begin = begin[rank < most]
        at = begin[:, None] + np.arange(WINDOW)
        out.append((t.features[:, at].transpose(1, 2, 0), tags[at]))
    return np.concatenate([f for f, _ in out]), np.concatenate([x for _, x in out])


def fit(docs: DataFrame, sample: int = 2500, windows_per_document: int = 16, id_column: str = "doc_id", text_column: str = "text") -> Field:
    """Trains on windows of at most ``sample`` documents, those with the least hashes of their doc_id; rows repeated under one doc_id are one."""
    src = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    ids = sorted({r[0] for r in src.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()})
    chosen = src.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")

    def run(batches):
        for _, texts in sliced(batches, "text", _SLICE):
            features, tags = windows(texts, windows_per_document)
            if len(tags):
                yield pa.RecordBatch.from_pydict({"features": pa.array([np.ascontiguousarray(f).tobytes() for f in features], pa.binary()), "tags": pa.array([x.tobytes() for x in tags], pa.binary())})

    rows = chosen.mapInArrow(run, "features binary, tags binary").distinct().toPandas().sort_values(["features", "tags"])
    if not len(rows):
        return Field(np.zeros((sum(SIZES), 3), np.float32), np.zeros((3, 3), np.float32))
    features = np.stack([np.frombuffer(b, np.int16).reshape(WINDOW, len(SIZES)) for b in rows["features"]])
    tags = np.stack([np.frombuffer(b, np.int8) for b in rows["tags"]])
    hidden = features[::2].copy()
    hidden[:, :, _WORD_FEATURES] = 0
    return train(np.concatenate([features, hidden]), np.concatenate([tags, tags[::2]]))


def find(texts: list, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, index of the kind, end) of all spans of each text, sorted."""
    found = [base_spans(t) if t else [] for t in texts]
    t = tokenize(texts)
    if not len(t.owner):
        return found
    tags = decode(field.emit(t.features), np.bincount(t.owner, minlength=len(texts))[np.unique(t.owner)], field.moves)
    starts = Points(texts).starts
    heads = np.flatnonzero(tags == _BEGIN)
    stops = np.append(np.flatnonzero(tags != _IN), len(tags))
    stops = stops[np.searchsorted(stops, heads, side="right")]
    stops = np.minimum(stops, np.searchsorted(t.owner, t.owner[heads], side="right"))
    added: dict[int, list] = {}
    known: dict[int, tuple[list[int], list[int]]] = {}
    for h, stop in zip(heads.tolist(), stops.tolist(), strict=True):
        i = int(t.owner[h])
        a, b = int(t.starts[h] - starts[i]), int(t.ends[stop - 1] - starts[i])
        if i not in known:  # starts of the base spans, and the furthest end up to each
            known[i] = [x for x, _, _ in found[i]], [0, *accumulate((y for _, _, y in found[i]), max)]
        if known[i][1][bisect_left(known[i][0], b)] <= a:
            added.setdefault(i, []).append((a, 3, b))
    for i, more in added.items():
        found[i] = sorted(found[i] + more)
    return found


def labels_agree(field: Field, texts: list) -> float:
    """The share of the base spans' first tokens that the field alone tags as a beginning."""
    t = tokenize(texts)
    want = labels([secret_spans(x or "") for x in texts], t, Points(texts).starts) == _BEGIN
    tags = decode(field.emit(t.features), np.bincount(t.owner, minlength=len(texts))[np.unique(t.owner)], field.moves) if len(t.owner) else want
    return float((tags[want] == _BEGIN).mean()) if want.any() else 1.0


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans. One pass, no shuffle."""

    def run(batches):
        for part, texts in sliced(batches, "text", _SLICE):
            found = find(texts, field)
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found], pa.string()), pa.array(map(joined, found), pa.string()), count(3)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_tagged"],
            )

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SCHEMA)


def spans(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per span, with its text."""

    def run(batches):
        for part, texts in sliced(batches, "text", _SLICE):
            rows = [(d, KINDS[k], a, b, t[a:b]) for d, t, f in zip(part.column(0).to_pylist(), texts, find(texts, field), strict=True) for a, k, b in f]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "kind", "start", "end", "secret"), map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SPAN_SCHEMA)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each group of overlapping spans replaced by one mark."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """The documents with their secrets masked; all rows and columns stay, the length column follows the new text."""
    at = docs.columns.index(text_column)

    def run(batches):
        for part, texts in sliced(batches, text_column, _SLICE):
            new = [redact(t, f) if f else t for t, f in zip(texts, find(texts, field), strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(new, pa.string())
            if length_column:
                k = part.schema.get_field_index(length_column)
                columns[k] = pa.array([o if n is t else len(n) for o, n, t in zip(columns[k].to_pylist(), new, texts, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
