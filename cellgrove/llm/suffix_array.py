"""Suffix arrays by induced sorting, a bucket at a time in numpy."""

from __future__ import annotations

import numpy as np

from . import exchange as X

#: Names of a reduced text that are still sorted bucket by bucket.
BUCKETS = 4096


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of an ascending array."""
    at = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *at.tolist(), len(values)]
    return [(int(values[a]), a, b) for a, b in zip(edges[:-1], edges[1:])] if len(values) else []


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, from the leftmost-smaller ones in order: first the larger ones from the left, then the smaller
    ones from the right. What a bucket yields is dealt to the buckets of its predecessors as a whole, in order."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    chars = t[lms]
    order = np.argsort(chars, kind="stable")
    for c, a, b in _runs(chars[order]):
        seeds[c].append(lms[order[a:b]])
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else lms[:0]

    def deal(found: np.ndarray, into: list[list[np.ndarray]], own: int) -> list[np.ndarray]:
        """Into the buckets of their values, in order; those of the own bucket are given back instead."""
        if not len(found):
            return []
        chars = t[found]
        order = np.argsort(chars, kind="stable")
        same = []
        for c, a, b in _runs(chars[order]):
            part = found[order[a:b]]
            same.append(part) if c == own else into[c].append(part)
        return same

    for c in range(size):
        wave = larger[c]
        while wave:  # what falls into this bucket itself comes after what is there
            p = joined(wave)
            p = p[p > 0] - 1
            wave = deal(p[~smaller[p]], larger, c)
            larger[c] += wave
        p = joined(seeds[c])
        p = p[p > 0] - 1
        deal(p[~smaller[p]], larger, -1)
    lesser: list[list[np.ndarray]] = [[] for _ in range(size)]  # each from the right
    for c in range(size - 1, -1, -1):
        wave = lesser[c]
        while wave:
            p = joined(wave)
            p = p[p > 0] - 1
            wave = deal(p[smaller[p]], lesser, c)
            lesser[c] += wave
        p = joined(larger[c])[::-1]
        p = p[p > 0] - 1
        deal(p[smaller[p]], lesser, -1)
    empty = np.zeros(0, np.int32)
    return np.concatenate([x for c in range(size) for x in (*larger[c], *[y[::-1] for y in reversed(lesser[c])])] or [empty])


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of t (small non-negative integers) in order; beyond `depth` values the order may be any.

    Suffixes are classified as smaller or larger than the next; the leftmost smaller ones cut the text into substrings,
    which one induction sorts and names. The reduced text of names is the recursive problem: its suffixes are ordered
    the same way while its names are no more than BUCKETS, else by doubling the names compared, as a large alphabet
    leaves too little in a bucket. A last induction gives all suffixes.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    size = int(t.max()) + 1
    # a run of equal values is as small or large as its end; the last suffix counts as larger, being followed by nothing
    last = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))
    kind = np.concatenate((t[last[:-1] + 1] > t[last[:-1]], [False]))
    smaller = np.repeat(kind, np.diff(last, prepend=-1))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # the end of the text stands for a smallest value of its own: the last suffix starts the first induction
    if not len(lms):
        return _with_end(t, smaller, lms, size)
    first = _with_end(t, smaller, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = first[is_lms[first]]
    at = np.searchsorted(lms, by_substring)
    stop = np.append(lms[1:] + 1, n)
    h = X.range_hash(X.prefix(X.mix(t.astype(np.uint64) + np.uint64(1))), lms, stop)
    h[-1] ^= np.uint64(1)  # the last substring ends with the text
    new = np.ones(len(at), bool)
    new[1:] = h[at[1:]] != h[at[:-1]]
    rank = np.empty(len(lms), np.int64)
    rank[at] = np.cumsum(new)
    step, names = 1, int(new.sum())
    if names < len(lms) and names <= BUCKETS:
        return _with_end(t, smaller, lms[suffix_array(rank - 1)], size)
    while names < len(lms) and (depth is None or step <= depth):
        after = np.zeros(len(lms), np.int64)
        after[:-step] = rank[step:] if step < len(lms) else 0
        key = (rank << 32) | after
        order = np.argsort(key, kind="stable")
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(new)
        step, names = 2 * step, int(new.sum())
        if step >= len(lms):
            break
    return _with_end(t, smaller, lms[np.argsort(rank, kind="stable")], size)


def _with_end(t, smaller, lms, size):
    """Induction with the end of the text as the smallest suffix, which is then left out."""
    n = len(t)
    shifted = np.append(t.astype(np.int16 if size < 1 << 15 else np.int64) + 1, 0).astype(np.int16 if size < 1 << 15 else np.int64)
    found = _induce(shifted, np.append(smaller, True), np.concatenate(([n], lms)).astype(np.int32), size + 1)
    return found[found < n]


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """The permuted common prefixes, up to `most`: for each suffix in text order, how much it shares with the one before
    it in the array. Compared 8 bytes at a time (t: bytes), all suffixes that still agree together."""
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((t.astype(np.uint8), np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    out = np.zeros(n, np.int64)
    alive = np.flatnonzero(before >= 0)
    done = 0
    while len(alive) and done < most:
        x = words[alive + done] ^ words[before[alive] + done]
        same = x == 0
        out[alive[same]] += 8
        rest, d = alive[~same], x[~same]
        low = d & (~d + np.uint64(1))  # the lowest differing bit tells the byte
        out[rest] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        alive = alive[same]
        done += 8
    room = np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0))
    return np.minimum(np.minimum(out, room), most)
