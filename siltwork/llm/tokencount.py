"""Token counts by deterministic finite-state transducers compiled from a byte-level BPE tokenizer file.

Two transducers run one after the other, both over chunks of the text at once:

* the splitter (8 states over 16 symbols of character classes with one look-ahead) marks where a
  piece of the split pattern begins. Each chunk is run from all 8 states, which gives its state map;
  a parallel prefix scan composes the maps, and so every chunk learns the state it begins in;
* the merger runs over bytes. Its state holds, for each suffix of the piece that can still grow into
  a vocabulary entry, the last token before that suffix and its count relative to the present one.
  A transition is annotated with the change of the token count, so the sum of the annotations is the
  number of tokens. States are made when they are first reached (the set is finite: suffixes are as
  long as the longest entry at most). A chunk's map is constant from the first piece border on. A chunk
  that lies inside one long piece has its map made for the state that the chunk before it gives from the
  first state; a scan over the chunks composes these maps, and where one ends in another state than the
  next was made for, the next is made for that state too (once for each content and state).

That the last tokens of all prefixes decide the whole encoding holds for merge-ranked BPE: parts of
an encoding are encodings, and a sequence is one if each pair of neighbours is.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each on its
own; only the id and text columns are read; texts of any length are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltwork.llm.batches import Points, sliced

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: The split pattern is fixed by the public byte-level tokenizers:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_LETTER, _NUMBER, _OTHER, _QUOTE1, _QUOTE2, _LAST_BLANK, _LAST_SPACE, _SPACE = range(8)
_IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _IN_SPACE, _AFTER_BLANK, _FRESH, _ONE_MORE, _TWO_MORE = range(8)
_CHUNK_CHARS, _CHUNK_BYTES = 64, 256
#: Above so many states the merger's tables are emptied and fill again; results do not change.
MAX_STATES = 200_000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, border before the character) by state and symbol; symbols from 8 on begin a text."""
    step, border = np.zeros((8, 16), np.int8), np.zeros((8, 16), bool)
    for state in range(8):
        for symbol in range(8):
            if state == _TWO_MORE:
                to, cut = _ONE_MORE, False
            elif state == _ONE_MORE:
                to, cut = _FRESH, False
            elif symbol in (_LETTER, _NUMBER, _OTHER):
                to, cut = symbol, state not in (symbol, _AFTER_BLANK)
            elif symbol in (_QUOTE1, _QUOTE2):
                joined = state in (_IN_OTHERS, _AFTER_BLANK)
                to, cut = (_IN_OTHERS if joined else _ONE_MORE if symbol == _QUOTE1 else _TWO_MORE), not joined
            elif symbol == _LAST_BLANK:
                to, cut = _AFTER_BLANK, True
            elif symbol == _LAST_SPACE:
                to, cut = _FRESH, True
            else:
                to, cut = _IN_SPACE, state != _IN_SPACE
            step[state, symbol], border[state, symbol] = to, cut
    step[:, 8:], border[:, 8:] = step[_FRESH, :8], True
    return step, border


_STEP, _BORDER = _splitter()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    if not _CLASSES:
        table = np.full(sys.maxunicode + 1, 2, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = 0
            elif kind == "N":
                table[c] = 1
        # Unicode's White_Space property.
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        _CLASSES.append(table)
    return _CLASSES[0]


def symbols(at: Points) -> np.ndarray:
    """The splitter's symbol of each character."""
    p = at.points
    n = len(p)
    kind = classes()[p]
    out = kind.copy()
    first = np.zeros(n, bool)
    first[at.starts[(at.starts < at.ends)]] = True
    last = np.concatenate([first[1:], np.ones(1, bool)])
    space_next = np.concatenate([kind[1:] == 3, np.ones(1, bool)]) | last
    out[kind == 3] = _SPACE
    end = (kind == 3) & ~space_next
    out[end] = np.where(p[end] == 32, _LAST_BLANK, _LAST_SPACE)
    for q in np.flatnonzero(p == 39):
        tail = bytes(min(int(c), 255) for c in p[q + 1 : q + 3])
        if q + 1 < n and not last[q]:
            if tail[:1] in (b"s", b"t", b"m", b"d"):
                out[q] = _QUOTE1
            elif tail in (b"re", b"ve", b"ll") and not last[q + 1]:
                out[q] = _QUOTE2
    out[first] += 8
    return out


def borders(symbol: np.ndarray) -> np.ndarray:
    """True where a piece begins: chunk maps, their prefix scan, and the outputs."""
    n = len(symbol)
    chunks = -(-n // _CHUNK_CHARS)
    grid = np.full(chunks * _CHUNK_CHARS, 8, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, _CHUNK_CHARS).T)
    flat, cut = _STEP.reshape(-1), _BORDER.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.int8), (chunks, 1))
    for row in grid:
        maps = flat[maps.astype(np.int16) * 16 + row[:, None]]
    shift = 1
    while shift < chunks:  # after this, maps[k] leads from the first state through chunks 0..k
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
        shift *= 2
    state = np.concatenate([np.full(1, _FRESH, np.int8), maps[:-1, _FRESH]])
    out = np.empty((_CHUNK_CHARS, chunks), bool)
    for k, row in enumerate(grid):
        at = state.astype(np.int16) * 16 + row
        out[k] = cut[at]
        state = flat[at]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def byte_alphabet() -> dict[str, int]:
    """The public byte-level tokenizers' printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The lazily compiled transducer of the merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        encode = lambda s: bytes(alphabet[c] for c in s)
        self.rank = {(encode(a), encode(b)): k for k, (a, b) in enumerate(pairs)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = nxt
            self.token[node] = t
        #: Tokens numbered as bytes, then in the order of their merges; the two halves of each merged one.
        self.serial = {bytes([b]): b for b in range(256)}
        self.halves: dict[int, tuple[bytes, bytes]] = {}
        for (a, b), k in self.rank.items():
            if a + b not in self.serial:
                self.serial[a + b], self.halves[k + 256] = k + 256, (a, b)
        self.fits: dict[tuple[bytes | None, bytes], bool] = {}
        self.grows: dict[tuple[int, bytes], bool] = {}
        self.below: list[int] = [0] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):  # children have larger numbers
            self.below[node] = sum(1 + self.below[c] for c in self.child[node].values())
        self.reset()

    def reset(self) -> None:
        #: A state: the (trie node of a suffix, last token before it, count there relative to now), longest suffix first.
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        #: Bytes are numbered as they appear, so that the tables are only as wide as the bytes in use.
        self.byte_number = np.full(256, -1, np.int16)
        self.bytes: list[int] = []
        self.next = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int8)

    def numbered(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.byte_number[b] < 0:
                self.byte_number[b] = len(self.bytes)
                self.bytes.append(int(b))
        while self.next.shape[1] < len(self.bytes):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)
        return self.byte_number[data].astype(np.uint8)

    def encode(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            merged, i, out = pair[0] + pair[1], 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(merged)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def neighbours(self, a: bytes | None, b: bytes) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if a is None:
                ok = self.encode(b) == [b]
            else:
                ok = self.neighbours(None, b) and self.stays(a, b)
            self.fits[key] = ok
        return ok

    def stays(self, a: bytes, b: bytes) -> bool:
        """True if no merge joins across the border of the tokens a, b: undo the later merge of the two sides step by
        step; a pair across the border that merges before the undone one would have been taken."""
        number, halves, joined = self.serial, self.halves, self.rank
        x, y, limit = number[a], number[b], 1 << 60
        while True:
            k = joined.get((a, b))
            if k is not None and k + 256 < limit:
                return False
            if (x > y and x >= 256) or y < 256:
                if x < 256:
                    return True
                limit, a = x, halves[x][1]
                x = number[a]
            else:
                limit, b = y + 1, halves[y][0]
                y = number[b]

    def useful(self, node: int, before: bytes | None) -> bool:
        """False if no entry below the node can follow ``before``; large subtrees are not searched."""
        if self.below[node] > 64 or before is None:
            return self.below[node] > 0
        ok = self.grows.get((node, before))
        if ok is None:
            ok, todo = False, [node]
            while todo and not ok:
                for c in self.child[todo.pop()].values():
                    if self.token[c] is not None and self.neighbours(before, self.token[c]):
                        ok = True
                        break
                    todo.append(c)
            self.grows[(node, before)] = ok
        return ok

    def compile(self, state: int, number: int) -> None:
        byte = self.bytes[number]
        last, change, grown = None, 0, []
        for node, before, count in self.states[state]:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if last is None and t is not None and self.neighbours(before, t):
                last, change = t, count + 1
            if self.useful(nxt, before):
                grown.append((nxt, before, count))
        key = (*((node, before, count - change) for node, before, count in grown), (0, last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        self.next[state, number], self.change[state, number] = to, change

    def walk(self, data: np.ndarray, out: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Runs the spans begin..end from their states in lockstep, writes each byte's change to out, returns the last states."""
        order = np.argsort(begin - end, kind="stable")
        begin, length, state = begin[order], (end - begin)[order], state[order].copy()
        live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for k, m in enumerate(live):
            at = begin[:m] + k
            byte = data[at]
            now = state[:m]
            to = self.next[now, byte]
            missing = np.flatnonzero(to < 0)
            if len(missing):
                for key in np.unique(now[missing].astype(np.int64) * 256 + byte[missing]):
                    self.compile(int(key) >> 8, int(key) & 255)
                to = self.next[now, byte]
            out[at] = self.change[now, byte]
            state[:m] = to
        back = np.empty_like(state)
        back[order] = state
        return back

    def changes(self, data: np.ndarray, border: np.ndarray) -> np.ndarray:
        """The change of the token count at each byte; border: where pieces begin."""
        n = len(data)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        if len(self.states) > MAX_STATES:
            self.reset()
            self.fits.clear()
            self.grows.clear()
        data = self.numbered(data)
        starts = np.arange(0, n, _CHUNK_BYTES)
        ends = np.minimum(starts + _CHUNK_BYTES, n)
        # Within a chunk a border resets the state: the spans between borders are what runs in lockstep.
        cuts = np.flatnonzero(border)
        k = np.searchsorted(cuts, starts)
        first = np.minimum(np.append(cuts, n)[k], ends)
        known = first < ends
        begin = np.concatenate([cuts, starts[first > starts]])
        stop = np.concatenate([np.minimum(np.append(cuts[1:], n), (cuts // _CHUNK_BYTES + 1) * _CHUNK_BYTES), first[first > starts]])
        m = len(cuts)
        last = self.walk(data, out, begin[:m], stop[:m], np.zeros(m, np.int32))
        exits = np.zeros(len(starts), np.int32)
        final = np.searchsorted(cuts, ends) - 1
        exits[known] = last[final[known]]
        through = np.flatnonzero(~known)
        if len(through):
            self._compose(data, out, starts[through], ends[through], through, exits, known)
        heads = np.flatnonzero((first > starts) & known)
        self.walk(data, out, starts[heads], first[heads], exits[heads - 1])
        return out

    def _compose(self, data: np.ndarray, out: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunks: np.ndarray, exits: np.ndarray, known: np.ndarray) -> None:
        """Sets the last states of the chunks that lie inside one piece, and their changes. A chunk always has one before it."""
        guess = self.walk(data, np.zeros_like(out), starts, ends, np.zeros(len(chunks), np.int32))
        after = known[chunks - 1]  # the chunk before has a border, so its last state is known
        enter = np.where(after, exits[chunks - 1], np.concatenate([np.zeros(1, np.int32), guess[:-1]]))
        leave = self.walk(data, out, starts, ends, enter)
        exits[chunks] = leave
        fits = after.copy()
        fits[1:] |= leave[:-1] == enter[1:]
        maps: dict[tuple[bytes, int], tuple[int, np.ndarray]] = {}
        for k in np.flatnonzero(~fits).tolist():
            # Goes on from the true state until a chunk was made for the state that it is entered in.
            while k < len(chunks) and not known[chunks[k] - 1] and exits[chunks[k] - 1] != enter[k]:
                a, b, state = int(starts[k]), int(ends[k]), int(exits[chunks[k] - 1])
                key = (data[a:b].tobytes(), state)
                if key not in maps:
                    maps[key] = self._run(data[a:b].tolist(), state)
                enter[k] = state
                exits[chunks[k]], out[a:b] = maps[key]
                k += 1

    def _run(self, data: list[int], state: int) -> tuple[int, np.ndarray]:
        """(last state, changes) of one chunk."""
        changes = np.empty(len(data), np.int8)
        for k, byte in enumerate(data):
            to = int(self.next[state, byte])
            if to < 0:
                self.compile(state, byte)
                to = int(self.next[state, byte])
            changes[k] = self.change[state, byte]
            state = to
        return state, changes


_MERGERS: dict[str, Merger] = {}


def count(texts: list, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    merger = _MERGERS.get(path)
    if merger is None:
        merger = _MERGERS[path] = Merger(path)
    parts, owner = [], []
    extra = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        pieces = [t or ""]
        for s in merger.special:
            if s in (t or ""):
                pieces = [x for p in pieces for x in p.split(s)]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    at = Points(parts)
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    tokens = np.zeros(len(texts), np.int64)
    if len(data):
        border = np.zeros(len(data), bool)
        border[np.flatnonzero((data & 0xC0) != 0x80)] = borders(symbols(at))
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(merger.changes(data, border), dtype=np.int64)])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        np.add.at(tokens, np.array(owner), total[ends] - total[starts])
    size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
    return size, tokens + extra


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with its bytes and tokens. One pass, no shuffle; ``path`` is on every machine."""

    def run(batches):
        for part, texts in sliced(batches, "text"):
            size, tokens = count(texts, path)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SCHEMA)
