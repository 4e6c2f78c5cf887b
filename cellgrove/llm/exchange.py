"""Hash exchange between chunks of documents and hash buckets.

A chunk (a bounded range of documents, see common.chunk_of) sends each bucket its distinct hashes once, sorted and
delta-coded; a bucket answers with one bit a hash. A value that a third of all rows share is therefore one entry a
chunk, and neither positions nor texts travel.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[base] = have = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of value * BASE ** i, for range_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def range_hash(p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values in each range, whatever its place."""
    return mix(((p[end] - p[begin]) * powers(INVERSE, len(p))[begin]) + (end - begin).astype(np.uint64))


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all k-grams."""
    n = len(p) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((p[k:] - p[:n]) * powers(INVERSE, n) + np.uint64(k))


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending distinct uint64 as byte planes of their differences, without the planes that are all zero."""
    if not len(sorted_values):
        return b""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    head, d[0] = int(d[0]), 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return head.to_bytes(8, "little") + bytes([width]) + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[8]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    d = wide.view("<u8").ravel().astype(np.uint64)
    d[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(d, dtype=np.uint64)


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_ids(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word data[begin:end], in two halves, equal for equal words only.

    Words of up to 15 bytes are taken as they are, with their length, and stirred by an invertible step, so different
    ones always differ; longer ones are known by a cryptographic digest.
    """
    at = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))  # the 8 bytes from each place on
    size = end - begin
    low = at[begin] & _LOW_BYTES[np.minimum(size, 8)]
    high = at[begin + 8] & _LOW_BYTES[np.clip(size - 8, 0, 7)] | np.minimum(size, 15).astype(np.uint64) << np.uint64(56)
    a = low + mix(high)
    b = high + mix(a)
    if len(long := np.flatnonzero(size > 15)):
        digests = b"".join(hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(begin[long].tolist(), end[long].tolist()))
        a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return a, b


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words' ids folded to 64 bits."""
    a, b = word_ids(data, begin, end)
    return mix(a ^ mix(b + np.uint64(0x9E3779B97F4A7C15)))


def bucket_of(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The buckets of bits-bit hashes: equal ranges, told by the upper 32 bits at most."""
    high = values >> np.uint64(max(0, bits - 32))
    return (high * np.uint64(buckets) >> np.uint64(min(bits, 32))).astype(np.int64)


def split(sorted_values: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that has values; the work grows with the values, not with the buckets."""
    if not len(sorted_values):
        return []
    of = bucket_of(sorted_values, buckets, bits)
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return list(zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(of)]))


def member(sorted_values: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """For each probe its place in sorted_values, or -1."""
    if not len(sorted_values):
        return np.full(len(probes), -1)
    i = np.searchsorted(sorted_values, probes)
    i[i == len(sorted_values)] = 0
    return np.where(sorted_values[i] == probes, i, -1)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(bool)


def pairs(key: np.ndarray, content: np.ndarray):
    """Distinct (key, content) in order, the place of the first of each, and which one each row is."""
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], c[new], order[new], inverse
