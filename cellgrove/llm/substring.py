"""Substring dedup on words: fixed-block anchors, probed by every rolling window."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import chunk_of, ordered

WINDOW = 20
#: Hashes that a bucket holds at most, about.
BUCKET_HASHES = 3_000_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLOCKS, PROBES, WINDOWS, FLAGS, REPLY1, REPLY2 = range(6)
SENT = "bucket int, chunk int, kind int, payload binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, SENT_ARROW.types)], schema=SENT_ARROW)


class Chunk:
    """The documents of one chunk in order, their words' hashes and the 10- and 20-word windows."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("t").to_pylist()
        texts = [t or b"" for t in texts]
        order = ordered(ids, texts)
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        raw = b" ".join(self.texts) + b" "
        space = SPACE[np.frombuffer(raw, np.uint8)]
        edge = np.diff(np.concatenate(([True], space)).view(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        first, second = X.word_ids(raw, begin, end)
        self.hashes = X.mix(first)
        stops = np.cumsum([len(t) + 1 for t in self.texts])
        self.bounds = np.searchsorted(begin, np.concatenate(([0], stops)))  # words before each document
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.bounds))
        self.window, self.block = window, (window + 1) // 2
        self.p = X.prefix(self.hashes)
        self.p2 = X.prefix(X.mix(second + np.uint64(1)))  # for a second hash of full windows, from the words' other halves

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts within one document, and their hashes."""
        h = X.grams(self.p, k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the chosen full windows within one document, and their 128-bit hashes in two halves."""
        at, h = self.grams(self.window)
        keep = chosen[at]
        return at[keep], h[keep], X.grams(self.p2, self.window)[at[keep]]

    def anchors(self, bits: int):
        """Rolling windows of a block's length: starts, hashes, and whether they are blocks of the fixed raster."""
        at, h = self.grams(self.block)
        return at, h >> np.uint64(64 - bits), (at - self.bounds[self.doc[at]]) % self.block == 0


def _send(chunk: int, kind: int, values: np.ndarray, buckets: int, bits: int):
    return [(b, chunk, kind, X.pack(values[i:j])) for b, i, j in X.split(values, buckets, bits)]


def _joined(rows, values: np.ndarray, buckets: int, bits: int, kind: int) -> np.ndarray:
    """The buckets' answers for the sorted values."""
    out = np.zeros(len(values), bool)
    got = {b: p for b, k, p in rows if k == kind}
    for b, i, j in X.split(values, buckets, bits):
        if b in got:
            out[i:j] = X.flags_of(got[b], j - i)
    return out


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word ranges removed), kept (the other words).

    A word goes if a window of `window` words that covers it has the same words as one that starts earlier (smaller
    doc_id, or same document, earlier start). 1. Each document's non-overlapping blocks of half a window are the
    index, spread over hash buckets; every rolling window of that length probes it, so whatever two equal windows
    share, each of them has a hit. 2. Around the hits, the windows of full length are compared by 128-bit hash, each
    chunk learning which of its own an earlier chunk has; adjoining repeats make maximal spans.
    Null or empty text: no words. Texts shorter than a window keep all words. Equal doc_ids go by a hash of the text; a repeated row
    is a copy of the one before; a null doc_id comes last. Empty tables give no rows; further columns are ignored.
    """
    chunk, _, total = chunk_of(docs)
    buckets = max(16, math.ceil(total / 5 / BUCKET_HASHES))
    bits = min(64, max(1, total // 5).bit_length() + 14)  # of anchors: false hits are settled by the full windows
    held = docs.select(chunk.alias("chunk"), "doc_id", F.col("text").cast("binary").alias("t"))

    def send_anchors(key, table):
        c, n = Chunk(table, window), key[0].as_py()
        _, h, is_block = c.anchors(bits)
        return _sent(_send(n, BLOCKS, np.unique(h[is_block]), buckets, bits) + _send(n, PROBES, np.unique(h), buckets, bits))

    def probe(table):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "payload"))))
        blocks = {c: X.unpack(p) for _, c, k, p in rows if k == BLOCKS}
        index, count = np.unique(np.concatenate([*blocks.values(), np.zeros(0, np.uint64)]), return_counts=True)
        out = []
        for b, c, k, p in rows:
            if k == PROBES:
                h = X.unpack(p)
                i = X.member(index, h)
                others = np.where(i >= 0, count[i] if len(count) else 0, 0)
                if c in blocks:
                    others = others - (X.member(blocks[c], h) >= 0)
                if (others > 0).any():
                    out.append((b, c, REPLY1, X.bits_of(others > 0)))
        return _sent(out)

    def candidates(c: Chunk, replies):
        at, h, is_block = c.anchors(bits)
        distinct, inverse = np.unique(h, return_inverse=True)
        hit = _joined(replies, distinct, buckets, bits, REPLY1)[inverse]
        own = np.bincount(inverse[is_block], minlength=len(distinct))
        hit |= own[inverse] - is_block > 0
        flags = np.zeros(len(c.hashes) + 1, np.int32)
        np.add.at(flags, np.maximum(at[hit] - (window - c.block), 0), 1)
        np.add.at(flags, at[hit] + 1, -1)
        return np.cumsum(flags[:-1]) > 0

    def send_windows(key, table, replies):
        n = key[0].as_py()
        c = Chunk(table, window)
        maybe = candidates(c, list(zip(*(replies.column(x).to_pylist() for x in ("bucket", "kind", "payload")))))
        k, t, _, _ = X.pairs(*c.windows(maybe)[1:])
        rows = [(b, n, WINDOWS, np.concatenate((k[i:j], t[i:j])).tobytes()) for b, i, j in X.split(k, buckets, 64)]
        return _sent(rows + ([(n % buckets, n, FLAGS, X.bits_of(maybe))] if rows else []))

    def first(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "payload"))), key=lambda r: r[1])
        out = [r for r in rows if r[2] == FLAGS]
        parts = [(c, np.frombuffer(p, np.uint64).reshape(2, -1)) for _, c, k, p in rows if k == WINDOWS]
        if parts:
            _, _, where, inverse = X.pairs(*(np.concatenate([x[half] for _, x in parts]) for half in (0, 1)))
            later = where[inverse] != np.arange(len(inverse))  # the sort is stable: the first is of the earliest chunk
            stop = np.cumsum([x.shape[1] for _, x in parts])
            out += [(rows[0][0], c, REPLY2, X.bits_of(later[e - x.shape[1] : e])) for (c, x), e in zip(parts, stop) if later[e - x.shape[1] : e].any()]
        return _sent(out)

    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), ("kept", pa.binary())])

    def remove(key, table, replies):
        c = Chunk(table, window)
        got = list(zip(*(replies.column(x).to_pylist() for x in ("bucket", "kind", "payload"))))
        gone = np.zeros(len(c.hashes) + 1, np.int32)
        if flags := [p for _, k, p in got if k == FLAGS]:
            maybe = X.flags_of(flags[0], len(c.hashes))
            at, h, h2 = c.windows(maybe)
            k, _, where, inverse = X.pairs(h, h2)
            dup = _joined(got, k, buckets, 64, REPLY2)[inverse] | (where[inverse] != np.arange(len(h)))
            np.add.at(gone, at[dup], 1)
            np.add.at(gone, at[dup] + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n_removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[c.bounds])
        spans, kept = [], []
        for i, text in enumerate(c.texts):
            w = text.split()
            if n_removed[i]:
                g = gone[c.bounds[i] : c.bounds[i + 1]]
                e = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"b": int(b), "e": int(x)} for b, x in zip(e[::2], e[1::2])])
                w = [x for x, y in zip(w, g.tolist()) if not y]
            else:
                spans.append([])
            kept.append(b" ".join(w))
        return pa.Table.from_arrays([pa.array(c.ids, pa.int64()), pa.array(np.diff(c.bounds)), pa.array(n_removed), pa.array(spans, final.field("spans").type), pa.array(kept, pa.binary())], schema=final)

    by_chunk = held.groupBy("chunk")
    sent = by_chunk.applyInArrow(send_anchors, SENT)
    hits = sent.groupBy("bucket").applyInArrow(probe, SENT)
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, SENT)
    firsts = sent.groupBy("bucket").applyInArrow(first, SENT)
    out = by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, spans array<struct<b:int,e:int>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, bytes]]:
    """The definition word by word, for tests: n_words, n_removed, kept."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out
