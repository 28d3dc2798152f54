"""Viterbi decoding of many sequences at once, in chunks whose max-plus maps are composed."""

from __future__ import annotations

import numpy as np

CHUNK = 64
_NEVER = -1e9


def _step(score: np.ndarray, move: np.ndarray | float) -> np.ndarray:
    """The best score of each label (first axis) before the next emission. move: a matrix, or the cost of any change of label."""
    if isinstance(move, np.ndarray):
        shape = (*move.shape, *[1] * (score.ndim - 1))
        return (score[:, None] + move.reshape(shape)).max(0)
    return np.maximum(score, score.max(0) - np.float32(move))


def _back(score: np.ndarray, move: np.ndarray | float) -> np.ndarray:
    """The label that each label comes from."""
    if isinstance(move, np.ndarray):
        return (score[:, None] + move[:, :, None]).argmax(0).astype(np.int8)
    own = np.arange(len(score), dtype=np.int8)[:, None]
    return np.where(score >= score.max(0) - np.float32(move), own, score.argmax(0).astype(np.int8))


def decode(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray | float) -> np.ndarray:
    """The best label of each row of ``emit`` (rows of sequence after sequence, by label); all labels may come first."""
    rows, labels = emit.shape
    out = np.zeros(rows, np.int8)
    if not rows:
        return out
    emit = np.ascontiguousarray(emit.T, np.float32)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    per = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = begins[owner] + rank * CHUNK
    size = np.minimum(CHUNK, ends[owner] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, owner, rank = begin[order], size[order], owner[order], rank[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    longest = int(per.max())
    #: by_rank[k]: the chunks that are the k-th of their sequence
    by_rank = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank, minlength=longest))[:-1])
    fresh = rank == 0  # their first row comes from no other

    enter = np.zeros((labels, len(owner)), np.float32)
    if longest > 1:
        maps = np.full((labels, labels, len(owner)), _NEVER, np.float32)  # last label, label before the chunk
        maps[np.arange(labels), np.arange(labels)] = 0
        for t, m in enumerate(live):
            maps[:, :, :m] = _step(maps[:, :, :m], move)
            if not t:
                maps[:, :, fresh] = 0
            maps[:, :, :m] += emit[:, begin[:m] + t][:, None]
        state = np.zeros((labels, len(lengths)), np.float32)
        for k, chunks in enumerate(by_rank):
            if k:
                enter[:, chunks] = state[:, owner[chunks]]
            after = (enter[None][:, :, chunks] + maps[:, :, chunks]).max(1)
            state[:, owner[chunks]] = after - after.max(0)
    score, back = enter.copy(), np.zeros((CHUNK, labels, len(owner)), np.int8)
    for t, m in enumerate(live):
        back[t, :, :m] = _back(score[:, :m], move)
        score[:, :m] = _step(score[:, :m], move)
        if not t:
            score[:, fresh] = 0
        score[:, :m] += emit[:, begin[:m] + t]
    lead = np.repeat(np.arange(labels, dtype=np.int8)[:, None], len(owner), axis=1)  # a chunk's last label -> the label before the chunk
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        lead[:, :m] = np.take_along_axis(back[t, :, :m], lead[:, :m].astype(np.intp), axis=0)
    last = np.zeros(len(owner), np.int8)
    follow = np.zeros(len(lengths), np.int8)
    for k in range(longest - 1, -1, -1):
        chunks = by_rank[k]
        final = rank[chunks] == per[owner[chunks]] - 1
        last[chunks] = np.where(final, score[:, chunks].argmax(0).astype(np.int8), follow[owner[chunks]])
        follow[owner[chunks]] = lead[last[chunks], chunks]
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        out[begin[:m] + t] = last[:m]
        last[:m] = back[t, last[:m], np.arange(m)]
    return out
