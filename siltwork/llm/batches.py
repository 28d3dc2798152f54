"""Arrow batches in bounded slices, and code-point arithmetic that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def sliced(batches, text_column: str, budget: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(part of a batch, its texts) with at most ``budget`` bytes of text, or one row. Nulls stay None; only one part's texts are Python strings at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_column))
        start, total = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if i > start and total + n > budget:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start).to_pylist()
        del batch, column
    release()


def release() -> None:
    """Gives free memory back to the system, so that a reused worker holds nothing of this task's batches."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


class Points:
    """The code points of several texts in one array, with the start of each text."""

    def __init__(self, texts: list) -> None:
        joined = "".join(t for t in texts if t)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)))
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(texts) else self.ends
        self._prefix = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of ``inside``, cut at the borders of texts."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        border = np.zeros(n + 1, bool)
        border[self.starts[self.starts < n]] = True
        before = np.concatenate([np.zeros(1, bool), inside[:-1]])
        after = np.concatenate([inside[1:], np.zeros(1, bool)])
        starts = np.flatnonzero(inside & (~before | border[:n]))
        ends = np.flatnonzero(inside & (~after | border[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of the words [^\\x20\\x09-\\x0D]+."""
        p = self.points
        starts, ends = self.runs(~((p == 32) | ((p >= 9) & (p <= 13))))
        return starts, ends, np.searchsorted(self.ends, starts, side="right")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit rolling hash of each span: the difference of two prefixes of one polynomial, mixed with the length."""
        n = len(self.points)
        up, down = _Powers.upto(n + 1)
        if self._prefix is None:
            values = mix(self.points.astype(np.uint64) + _MULT)
            values *= up[:n]
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        h = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _MULT))


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the n-word windows inside each text, and the index of the first word of each."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + words[at + k]
    return mix(h), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
    flag = np.zeros(len(s), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.zeros(len(s), bool)
    out[order] = flag
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key came earlier."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(s), bool)
    if len(s):
        out[order[1:]] = s[1:] == s[:-1]
    return out
