"""Packing of tokenized documents into fixed-length sequences: bounded-space online best fit.

Each partition keeps ``open_windows`` windows. A document goes into the window that it fills best; if it
fits none, the fullest window is filled with the document's head and emitted, and the rest goes on (a
head of under ``min_head`` tokens is not cut off: the window is then emitted as it is). What stays open at
the end of a partition is merged by best fit with that of ``MERGED`` partitions, in as many tasks as there
are such groups.

Defined results: a null text is an empty one, whose only id is the end id; repeated rows are packed each on
its own; a document longer than a window is cut; other columns are not read. Sequences with as many ids as
a power of two are not padded, the others are padded to the window.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.batches import sliced
from siltwork.sources.session import shared_folder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"
_OPEN = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, open boolean"
_NAMES = [c.split()[0] for c in _OPEN.split(", ")]
#: So many partitions' open windows are merged in one task.
MERGED = 64
#: An encoder keeps so many words; beyond, it starts anew.
_CACHE = 200_000
#: Bytes of text encoded at once.
_SLICE = 1_000_000
#: Characters whose lower case, classes and normal form Python and the tokenizer library surely give alike.
_ODD = re.compile("[^\\x00-\\x1b\\x20-ɏ]|[²³¹¼-¾İŉ]")
_PLAIN_BYTES = bytes(c for c in range(256) if not _ODD.match(chr(c)))
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Merges:
    """The merges of a BPE file with word ends, done on many pieces at once: the pair of the least rank, the leftmost first."""

    LONGEST, BITS = 64, 18
    _NONE = np.int32(1 << 30)

    def __init__(self, spec: dict) -> None:
        from siltwork.llm.tokencount import byte_alphabet

        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in byte_alphabet().items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.span = np.int64(len(vocab) + 1)
        keys = np.array([vocab[a] * int(self.span) + vocab[b] for a, b in pairs], np.int64)
        #: Pairs by hash, in as many tables as it takes for each to have a slot of its own.
        self.tables = []
        left = np.arange(len(keys))
        while len(left):
            shift, odd = np.uint64(64 - self.BITS), np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            slot = (keys[left].astype(np.uint64) * odd >> shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key, rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self._NONE, np.int32)
            key[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.tables.append((odd, shift, key, rank))
            left = np.delete(left, first)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a * self.span + b, -2)
        out = np.full(key.shape, self._NONE, np.int32)
        for odd, shift, keys, rank in self.tables:
            slot = (key.astype(np.uint64) * odd >> shift).astype(np.int64)
            np.copyto(out, rank[slot], where=keys[slot] == key)
        return out

    def __call__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of piece after piece, how many each has); pieces of 1 to LONGEST bytes of the data."""
        count, kept = np.zeros(len(sizes), np.int64), []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, self.LONGEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if not len(rows):
                continue
            column = np.arange(high)
            inside = column < sizes[rows][:, None]
            raw = data[np.minimum(begins[rows][:, None] + column, len(data) - 1)]
            ids = np.where(inside, np.where(column == sizes[rows][:, None] - 1, self.final[raw], self.inner[raw]), -1).astype(np.int64)
            left, live = sizes[rows].copy(), np.arange(len(rows))
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            done = ids.copy()
            while len(live):
                j = rank.argmin(1)
                at = np.arange(len(live))
                best = rank[at, j]
                more = best < self._NONE
                if not more.all():
                    done[live[~more]] = ids[~more]
                    live, ids, rank, j, best = live[more], ids[more], rank[more], j[more], best[more]
                    at = at[: len(live)]
                if not len(live):
                    break
                left[live] -= 1
                ids = np.take_along_axis(ids, np.minimum(column + (column > j[:, None]), high - 1), 1)
                ids[:, -1] = -1
                ids[at, j] = self.joined[best]
                place = np.arange(high - 1)
                rank = np.take_along_axis(rank, np.minimum(place + (place > j[:, None]), high - 2), 1)
                rank[:, -1] = self._NONE
                to = np.minimum(j, high - 2)
                rank[at, to] = self.ranks(ids[at, to], ids[at, to + 1])
                before = np.maximum(j - 1, 0)
                rank[at, before] = self.ranks(ids[at, before], ids[at, before + 1])
            count[rows] = left
            kept.append((rows, done, left))
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, done, left in kept:
            inside = np.arange(done.shape[1]) < left[:, None]
            out[((ends - count)[rows][:, None] + np.arange(done.shape[1]))[inside]] = done[inside]
        return out, count


class Encoder:
    """ids of texts by the tokenizer file. No piece of its split pattern spans white space, so the ids of what stands
    between white space are kept and looked up; texts beyond the plain characters go to the library whole."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        #: The cache is only for a tokenizer that lowers case and splits by this pattern.
        self.cached = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in spec and '"Lowercase"' in spec and '"NFC"' in spec
        self.merges = Merges(json.loads(spec)) if self.cached else None
        self._library = None
        self.clear()

    @property
    def library(self):
        """The tokenizer library's own encoder, loaded when a text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def rest(self) -> None:
        """Keeps the tables of merges only, so that no later operator finds a reused worker's memory taken."""
        self.clear()
        self._library = None

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        first = len(self.index)
        whole = [w for w in new if w.isalpha()]  # each is one piece
        split = [_PIECE.findall(w) for w in new if not w.isalpha()]
        known = dict(zip(whole, range(len(whole)), strict=True))
        rest = np.fromiter((known.setdefault(p, len(known)) for ps in split for p in ps), np.int64)
        new = [*whole, *(w for w in new if not w.isalpha())]
        raw = pa.array(list(known), pa.large_string())
        _, offsets, data = raw.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(raw) + 1]
        size = np.diff(offsets)
        long = np.flatnonzero(size > Merges.LONGEST)  # such pieces go to the library
        ids, count = self.merges(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.where(size > Merges.LONGEST, 1, size))
        if len(long):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in long.tolist():
                parts[k] = np.array(self.library.encode(raw[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.concatenate([np.arange(len(whole)), rest])
        own = count[at]
        ends = np.cumsum(own)
        flat = ids[np.repeat((np.cumsum(count) - count)[at] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        sizes = np.diff(np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum([0, *[1] * len(whole), *map(len, split)])])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(new)] = sizes
        self.used += len(flat)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))

    def __call__(self, texts: list) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        lowered, owners = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif not self.cached or not plain(t):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                lowered.append(t.lower())
                owners.append(i)
        if not owners:
            return out
        if len(self.index) > _CACHE:
            self.clear()
        # Arrow splits and numbers the words; only the different ones of these texts are looked up.
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.string()))
        words = split.values.dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = list(set(names).difference(self.index))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = np.concatenate([np.zeros(1, np.int64), ends])[split.offsets.to_numpy()]
        for k, i in enumerate(owners):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out


def plain(text: str) -> bool:
    """True if all characters are ones that Python and the tokenizer library surely treat alike, and no special token is spelled."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return _ODD.search(text) is None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by a worker from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


class Packer:
    """The open windows of one partition. Pieces: (doc, start, length, crc, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, min_head: int) -> None:
        self.window, self.most, self.min_head = window, open_windows, min_head
        self.open: list[tuple[int, int]] = []  # (room, key), sorted
        self.pieces: dict[int, list] = {}
        self.serial = 0

    def add(self, doc, ids: np.ndarray):
        """Yields the windows that are emitted."""
        ids = ids.astype("<u4")
        start, total = 0, len(ids)
        while start < total:
            left = total - start
            if left >= self.window:
                yield [self._piece(doc, ids, start, self.window)]
                start += self.window
                continue
            k = bisect_left(self.open, (left, -1))
            if k < len(self.open):  # the window with the least room that is enough
                room, key = self.open.pop(k)
                self.pieces[key].append(self._piece(doc, ids, start, left))
                if room > left:
                    insort(self.open, (room - left, key))
                else:
                    yield self.pieces.pop(key)
                return
            if len(self.open) < self.most:
                self.serial += 1
                self.pieces[self.serial] = [self._piece(doc, ids, start, left)]
                insort(self.open, (self.window - left, self.serial))
                return
            room, key = self.open.pop(0)
            if room >= self.min_head:
                self.pieces[key].append(self._piece(doc, ids, start, room))
                start += room
            yield self.pieces.pop(key)

    @staticmethod
    def _piece(doc, ids: np.ndarray, start: int, n: int) -> tuple:
        return (doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))


def _rows(windows: list[tuple[int, list, bool]], window: int) -> pa.RecordBatch:
    rows = []
    for number, pieces, is_open in windows:
        fill = sum(p[2] for p in pieces)
        padded = fill if power_of_two(fill) else window
        at = 0
        for p in pieces:
            rows.append((*p, number, at, padded, is_open))
            at += p[2]
    return pa.RecordBatch.from_pydict(dict(zip(_NAMES, map(list, zip(*rows, strict=True)), strict=True)), schema=_ARROW)


_ARROW = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in _NAMES])


def pack(docs: DataFrame, path: str, window: int = 4096, open_windows: int = 16, end_id: int = 2, min_head: int = 32, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece. Texts are tokenized once; only rows of pieces are checkpointed, and only those of open windows shuffled."""

    def run(batches):
        part = TaskContext.get().partitionId()
        encode, packer, serial, ready = encoder(path), Packer(window, open_windows, min_head), 0, []
        for batch, texts in sliced(batches, "text", _SLICE):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                for pieces in packer.add(doc, np.append(ids, np.uint32(end_id))):
                    ready.append(((part << 32) + serial, pieces, False))
                    serial += 1
            if ready:
                yield _rows(ready, window)
                ready = []
        encode.rest()
        left = [((part << 32) + serial + k, p, True) for k, p in enumerate(packer.pieces.values())]
        if left:
            yield _rows(left, window)

    shared_folder(docs.sparkSession)
    placed = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, _OPEN)
    placed = placed.checkpoint()
    group = F.shiftright(F.col("sequence_id"), 32) / F.lit(MERGED)
    merged = placed.where("open").withColumn("part", group.cast("long")).groupBy("part").applyInArrow(lambda t: _merged(t, window), _OPEN)
    return placed.where("not open").unionByName(merged).drop("open")


def _merged(table: pa.Table, window: int) -> pa.Table:
    part = table.column("part")[0].as_py() if table.num_rows else 0
    pieces = sorted(zip(*(table.column(n).to_pylist() for n in _NAMES[:5]), strict=True), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
    bins: list[tuple[int, int]] = []
    held: list[list] = []
    for p in pieces:
        k = bisect_left(bins, (p[2], -1))
        if k < len(bins):
            room, b = bins.pop(k)
        else:
            room, b = window, len(held)
            held.append([])
        held[b].append(p)
        insort(bins, (room - p[2], b))
    return pa.Table.from_batches([_rows([((1 << 61) + (part << 32) + b, ps, False) for b, ps in enumerate(held)], window)]) if held else _ARROW.empty_table()

