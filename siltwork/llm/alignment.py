"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece model (B) cover the same bytes.

Both encode space + text, so their tokens are intervals over the same bytes. The starts and the ends of B's tokens,
both sorted, are a static interval index: two bisections for each A token give the B tokens that it overlaps (a link
for each). Offsets that no token of either spans are the borders of groups.

Documents are handled in chunks of about ``CHUNK`` bytes. A chunk is tokenized once and written with the number of
each of its links in a dictionary of its own; only the dictionaries' counts are shuffled by pair of ids, summed over
the corpus and sent back to their chunks. A pair of ids is one row a chunk, however frequent it is.

Defined results: null and empty texts, and texts whose joined tokens differ from space + text in either tokenizer,
have no tokens: zeros and empty groups. Special tokens' strings in a text are plain text. Texts of any length are read
whole. Repeated rows are aligned and counted each on its own; doc_id may be null; other columns are not read; an
empty table gives an empty table. Links are counted over exactly the rows given; ties for a B id's highest count are
all best.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.llm.batches import sliced
from siltwork.llm.tokencount import byte_alphabet
from siltwork.sources.session import shared_folder

#: Bytes of text that share a dictionary; a longer text has one of its own.
CHUNK = 4_000_000
#: The encoder of pieces keeps so many words; beyond, it starts anew.
WORDS = 200_000
#: The split pattern of the public byte-level tokenizer files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = re.compile(" +[^ ]*")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_PASS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, number long, pair long, count long"
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in _PASS.split(", "))])


class ByteTokens:
    """A byte-level BPE file: ids of texts, and how many bytes each id stands for. Merge ranks follow ids, as in these files."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(alphabet[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if entry not in special}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.sizes[i] = len(b)
        self._ordinary = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self._ordinary(text), np.int64)


class PieceTokens:
    """A sentence-piece file. No piece goes on after a space that ends a word, so words (spaces, then others) are encoded
    apart and kept; ``sound`` says of each whether its pieces' bytes are the word's."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, apart = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
            apart &= "▁" not in piece.lstrip("▁")
        if not apart:
            raise ValueError(f"{path}: a piece spans the border of two words")
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.counts, self.sound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, words: set[str]) -> None:
        new = list(words - self.number.keys())
        if len(self.number) + len(new) > WORDS:
            self._clear()
            new = list(words)
        if not new:
            return
        # The model puts a space before what it encodes, but before nothing.
        found = self.model.encode([w[1:] for w in new], num_threads=1)
        found = [[self.model.piece_to_id("▁")] if w == " " else ids for w, ids in zip(new, found, strict=True)]
        counts = np.array([len(i) for i in found], np.int64)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.ids = np.append(self.ids, np.fromiter((i for ids in found for i in ids), np.int64, counts.sum()))
        self.counts = np.append(self.counts, counts)
        self.sound = np.append(self.sound, [b"".join([self.bytes[i] for i in ids]) == w.encode() for w, ids in zip(new, found, strict=True)])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of text after text, how many each has, whether its bytes are the text's)."""
        words = [_WORD.findall(t) for t in texts]
        self.learn({w for ws in words for w in ws})
        lengths = np.array([len(ws) for ws in words], np.int64)
        at = np.fromiter((self.number[w] for ws in words for w in ws), np.int64, lengths.sum())
        counts = self.counts[at]
        ids = self.ids[_ranges(self.starts[at], counts)]
        owner = np.repeat(np.arange(len(texts)), lengths)
        each = np.bincount(owner, counts, len(texts)).astype(np.int64)
        return ids, each, np.bincount(owner, ~self.sound[at], len(texts)) == 0


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rows of intervals over the same bytes: the positions of all overlapping pairs, and the offsets at which groups end."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first = np.searchsorted(b_end, a_end - a_sizes, side="right")
    count = np.searchsorted(b_end - b_sizes, a_end, side="left") - first
    return np.repeat(np.arange(len(a_sizes)), count), _ranges(first, count), np.intersect1d(a_end, b_end, assume_unique=True)


class Aligner:
    """Both tokenizers over slices of texts."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        n, m = len(self.a.sizes), len(self.b.sizes)
        self._parts = pa.array([f"{i}{s}" for i in range(n) for s in ",|"] + [f"{i}{s}" for i in range(m) for s in (",", ";", "")])

    def __call__(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, n_links of each text; its groups as strings; its links' pairs, text after text)."""
        n = len(texts)
        n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        spaced = [" " + texts[i] for i in rows]
        a = [self.a(t) for t in spaced]
        b_ids, b_count, sound = self.b(spaced)
        sound &= np.array([self.a.sizes[ids].sum() == len(t.encode()) for ids, t in zip(a, spaced, strict=True)], bool)
        a, b_ids, b_count, rows = [x for x, s in zip(a, sound, strict=True) if s], b_ids[np.repeat(sound, b_count)], b_count[sound], rows[sound]
        a_count = np.array([len(x) for x in a], np.int64)
        a_ids = np.concatenate([np.zeros(0, np.int64), *a])
        a_at, b_at, ends = links(self.a.sizes[a_ids], self.b.sizes[b_ids])
        # Texts follow each other, and each ends with a group: a link never joins two texts.
        last_a, last_b = np.cumsum(a_count), np.cumsum(b_count)
        a_end, b_end = np.cumsum(self.a.sizes[a_ids]), np.cumsum(self.b.sizes[b_ids])
        text_end = np.searchsorted(ends, a_end[last_a - 1]) + 1 if len(rows) else np.zeros(0, np.int64)
        n_a[rows], n_b[rows] = a_count, b_count
        n_groups[rows] = np.diff(text_end, prepend=0)
        n_links[rows] = np.diff(np.searchsorted(a_at, last_a), prepend=0)

        group_a, group_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        place_a = np.arange(len(a_ids)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(b_ids)) + np.searchsorted(group_a, group_b, side="right")
        code = np.zeros(len(a_ids) + len(b_ids), np.int64)
        code[place_a] = a_ids * 2 + np.isin(a_end, ends, assume_unique=True)
        closes = np.isin(b_end, ends, assume_unique=True).astype(np.int64)
        closes[last_b - 1] = 2
        code[place_b] = 2 * len(self.a.sizes) + b_ids * 3 + closes
        counts = np.zeros(n, np.int64)
        counts[rows] = a_count + b_count
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        groups = pc.binary_join(pa.ListArray.from_arrays(offsets, self._parts.take(pa.array(code))), "").to_pylist()
        return n_a, n_b, n_groups, n_links, groups, a_ids[a_at] * len(self.b.sizes) + b_ids[b_at]


def align(docs: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), one row per document; nothing is shuffled."""

    def run(batches):
        aligner = Aligner(byte_path, piece_path)
        for batch, texts in sliced(batches, "text"):
            n_a, n_b, n_groups, n_links, groups, _ = aligner(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return _read(docs, id_column, text_column).mapInArrow(run, ALIGNED)


def _read(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _chunks(batches, byte_path: str, piece_path: str, digest: bool):
    """Rows of documents, each with the numbers of its links in the chunk's dictionary, and the rows of the dictionary."""
    aligner, part, serial, held, size = Aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0, [], 0

    def closed():
        chunk = (part << 32) + serial
        pairs, numbers, counts = np.unique(np.concatenate([h[-1] for h in held]), return_inverse=True, return_counts=True)
        numbers, at = numbers.astype("<u4"), 0
        for ids, n_a, n_b, n_groups, n_links, groups, own in held:
            ends = at + np.cumsum(n_links)
            raw = [numbers[e - k : e].tobytes() for e, k in zip(ends.tolist(), n_links.tolist(), strict=True)]
            at += len(own)
            yield _batch(chunk=np.full(len(ids), chunk), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups=groups, links=raw)
        if len(pairs):
            yield _batch(chunk=np.full(len(pairs), chunk), number=np.arange(len(pairs)), pair=pairs, count=counts)

    for batch, texts in sliced(batches, "text"):
        n_a, n_b, n_groups, n_links, groups, own = aligner(texts)
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        held.append((batch.column(0), n_a, n_b, n_groups, n_links, groups, own))
        size += sum(len(t) for t in texts if t)
        if size >= CHUNK:
            yield from closed()
            serial, held, size = serial + 1, [], 0
    if held:
        yield from closed()


def _summed(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """Each document's sums over its links, from the corpus-wide counts of its chunk's pairs."""
    order = np.argsort(np.asarray(dictionary.column("number")))
    total, best = (np.asarray(dictionary.column(n))[order].astype(np.int64) for n in ("total", "best"))
    raw = docs.column("links").to_pylist()
    at = np.frombuffer(b"".join(raw), "<u4")
    ends = np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends], prepend=0) for x in (best, total)]
    kept = docs.drop_columns(["links", "chunk"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def scored(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`align` with n_best and count_sum of each document; with ``digest`` the groups are their SHA-256 ('' without tokens)."""
    spark = docs.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"  # the result reads it, so it stays
    _read(docs, id_column, text_column).mapInArrow(lambda b: _chunks(b, byte_path, piece_path, digest), _PASS).write.parquet(place)
    written = lambda: spark.read.schema(_PASS).parquet(place)  # noqa: E731  read apart: both sides of the cogroup have a column chunk
    dictionary, texts = written().where("pair is not null").select("chunk", "number", "pair", "count"), written().where("pair is null").drop("number", "pair", "count")
    pieces = PieceTokens(piece_path).model.get_piece_size()
    totals = dictionary.groupBy("pair").agg(F.sum("count").alias("total"))
    highest = Window.partitionBy(F.col("pair") % pieces)
    totals = totals.withColumn("best", (F.col("total") == F.max("total").over(highest)).cast("long"))
    known = dictionary.join(totals, "pair").select("chunk", "number", "total", "best")
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed, ALIGNED + ", n_best long, count_sum long")
