"""Suffix-array dedup on bytes: shards of a suffix array built by induced sorting find what starts earlier elsewhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import chunk_of, ordered
from .substring import SENT, _joined, _send, _sent
from .suffix_array import common_prefixes, suffix_array

LENGTH = 100
#: Bytes of an anchor: the anchor of a string is its gram of this length with the least hash, the leftmost of equals.
GRAM = 32
#: Different texts around one anchor that still go to one shard; beyond, its strings are dealt by the bytes around it.
HOT = 20_000
#: Places of the anchor in its strings that then stay together; all of them have length - STRIDE + 1 bytes in common.
STRIDE = 9
BUCKET_ANCHORS = 100_000
CHUNK_BYTES = 1 << 20
PLACE_BITS = 24
KEYS, TEXTS, FLAGS1, FLAGS2, SEEN, LATER, SHARED, REPLY3, REPLY4, CONTENTS = range(10)


class Chunk:
    """The documents of one chunk in order, cut into segments: runs of string starts with one anchor."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("t").to_pylist()
        texts = [t or b"" for t in texts]
        order = ordered(ids, texts)
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.lens = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.stops = np.cumsum(self.lens)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.length = length
        n = len(self.data)
        self.p = X.prefix(X.BYTE[self.data])
        count = np.maximum(self.lens - length + 1, 0)
        if not count.sum():
            self.begin = self.end = self.anchor = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        g = X.grams(self.p, gram)
        low = (g & ~np.uint64((1 << PLACE_BITS) - 1)) if n < 1 << PLACE_BITS else None
        if low is not None:
            m, width, span = low | np.arange(len(g), dtype=np.uint64), length - gram + 1, 1
            while span * 2 <= width:
                m = np.minimum(m[:-span], m[span:])
                span *= 2
            if width > span:
                m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
            anchor = (m & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            del m, low
        else:  # a text too long for places beside hashes: the same rule, block by block
            anchor = np.concatenate([self._anchors(g, a, min(a + (1 << 20), n - length + 1), length - gram + 1) for a in range(0, n - length + 1, 1 << 20)])
        ok = np.zeros(n + 1, np.int32)
        starts = (self.stops - self.lens)[count > 0]
        np.add.at(ok, starts, 1)
        np.add.at(ok, starts + count[count > 0], -1)
        ok = np.cumsum(ok[: len(anchor)]) > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        new[starts] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(anchor))
        keep = ok[begin]
        self.begin, self.end = begin[keep], end[keep]  # of the starts
        self.anchor = anchor[self.begin]
        self.key = X.mix(g[self.anchor] + np.uint64(1))  # least hashes are small: spread them over all buckets
        del g, anchor, ok, new
        self.content = X.mix(X.range_hash(self.p, self.begin, self.end + length - 1) ^ (self.anchor - self.begin).astype(np.uint64))

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The chosen segments cut by the place of the anchor in their strings: begin, end, key, and whether a run before
        it in this chunk is the same. The key is of the bytes that all strings of a run have in common."""
        none = np.zeros(0, np.int64)
        if not chosen.any():
            return none, none, none.astype(np.uint64), none.astype(bool)
        seg = np.flatnonzero(chosen)
        counts = self.end[seg] - self.begin[seg]
        start = np.repeat(self.begin[seg] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        of, place = np.repeat(seg, counts), np.repeat(self.anchor[seg], counts) - start
        group = place // STRIDE
        cut = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (group[1:] != group[:-1]))))
        begin, end, anchor, group = start[cut], start[np.append(cut[1:], len(start)) - 1] + 1, self.anchor[of[cut]], group[cut]
        shared = anchor - group * STRIDE
        key = X.mix(X.range_hash(self.p, shared, shared + self.length - STRIDE + 1) + group.astype(np.uint64))
        content = X.mix(X.range_hash(self.p, begin, end + self.length - 1) ^ (anchor - begin).astype(np.uint64))
        _, _, first, inverse = X.pairs(key, content)
        return begin, end, key, first[inverse] != np.arange(len(key))

    @staticmethod
    def _anchors(g, a, b, width):
        low = g[a : b + width - 1] & ~np.uint64((1 << PLACE_BITS) - 1)
        m = low | np.arange(len(low), dtype=np.uint64)
        out = np.lib.stride_tricks.sliding_window_view(m, width).min(axis=1)
        return (out & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + a


def _rows(table: pa.Table, names=("bucket", "chunk", "kind", "payload")):
    return list(zip(*(table.column(c).to_pylist() for c in names)))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed), kept (the other bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or same document,
    earlier start). Equal strings have equal anchors at equal places, so: 1. anchors that occur once are left alone.
    2. Of segments with equal text the first stands for all; the others repeat it as a whole. 3. First segments that
    share an anchor with different ones go to the shard of that anchor, in order. A shard classifies the suffixes of
    their joint text, sorts and names the leftmost smaller substrings, orders the reduced text, induces all suffixes
    and takes the permuted common prefixes; where neighbours share `length` bytes, all but the earliest go.
    An anchor in more than HOT different texts is no key for one shard: its strings are cut by the place that the
    anchor has in them and dealt by the bytes that such strings have in common, so that they spread over all shards.
    Null text: no bytes. Texts shorter than `length` stay. Equal doc_ids go by a hash of the text; a repeated row is a copy of the
    one before; a null doc_id comes last. An empty table gives no rows; further columns are ignored.
    """
    chunk, _, total = chunk_of(docs, CHUNK_BYTES)
    buckets = max(16, math.ceil(total / 30 / BUCKET_ANCHORS))
    held = docs.select(chunk.alias("chunk"), "doc_id", F.col("text").cast("binary").alias("t"))

    def send_keys(key, table):
        c = Chunk(table, length, gram)
        return _sent(_send(key[0].as_py(), KEYS, np.unique(c.key), buckets, 64))

    def common(table):
        rows = _rows(table)
        parts = [X.unpack(r[3]) for r in rows]
        index, count = np.unique(np.concatenate(parts), return_counts=True)
        out = []
        for (b, n, _, _), p in zip(rows, parts):
            if (seen := count[X.member(index, p)] > 1).any():
                out.append((b, n, SEEN, X.bits_of(seen)))
        return _sent(out)

    def send_contents(key, table, replies):
        n = key[0].as_py()
        c = Chunk(table, length, gram)
        distinct, inverse, own = np.unique(c.key, return_inverse=True, return_counts=True)
        maybe = (_joined(_rows(replies, ("bucket", "kind", "payload")), distinct, buckets, 64, SEEN) | (own > 1))[inverse]
        k, t, _, _ = X.pairs(c.key[maybe], c.content[maybe])
        rows = [(b, n, CONTENTS, np.concatenate((k[i:j], t[i:j])).tobytes()) for b, i, j in X.split(k, buckets, 64)]
        return _sent(rows + ([(n % buckets, n, FLAGS1, X.bits_of(maybe))] if rows else []))

    def firsts(table):
        rows = sorted(_rows(table), key=lambda r: r[1])
        out = [r for r in rows if r[2] == FLAGS1]
        rows = [r for r in rows if r[2] == CONTENTS]
        if rows:
            both = [np.frombuffer(r[3], np.uint64).reshape(2, -1) for r in rows]
            key, content = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
            k, _, first, inverse = X.pairs(key, content)  # stable: the first is of the earliest chunk
            later = first[inverse] != np.arange(len(key))
            _, group, texts = np.unique(k, return_inverse=True, return_counts=True)
            texts = texts[group][inverse]
            e = 0
            for r, x in zip(rows, both):
                a, e = e, e + x.shape[1]
                for kind, flags in ((LATER, later[a:e]), (SHARED, texts[a:e] > 1), (REPLY4, texts[a:e] > HOT)):
                    if flags.any():
                        out.append((r[0], r[1], kind, X.bits_of(flags)))
        return _sent(out)

    def state(c: Chunk, replies):
        """Of each segment: whether it repeats an earlier one, goes to a suffix array, or goes there in runs."""
        n = len(c.key)
        repeat, shard, hot = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        if flags := [p for _, k, p in replies if k == FLAGS1]:
            at = np.flatnonzero(X.flags_of(flags[0], n))
            k, _, first, inverse = X.pairs(c.key[at], c.content[at])
            later, shared, many = (_joined(replies, k, buckets, 64, x) for x in (LATER, SHARED, REPLY4))
            repeat[at] = later[inverse] | (first[inverse] != np.arange(len(at)))
            alone = shared[inverse] & ~repeat[at]
            shard[at], hot[at] = alone & ~many[inverse], alone & many[inverse]
        return repeat, shard, hot

    def send_texts(key, table, replies):
        n = key[0].as_py()
        c = Chunk(table, length, gram)
        repeat, shard, hot = state(c, _rows(replies, ("bucket", "kind", "payload")))
        out = []
        if repeat.any() or shard.any() or hot.any():
            out.append((n % buckets, n, FLAGS2, X.bits_of(np.concatenate((repeat, shard, hot)))))
        begin, end, bucket, _ = sent_runs(c, shard, hot)
        order = np.argsort(bucket, kind="stable")
        for b in np.unique(bucket):
            own = order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, side="right")]
            text = b"".join(c.data[i : j + length - 1].tobytes() for i, j in zip(begin[own], end[own]))
            out.append((int(b), n, TEXTS, len(own).to_bytes(4, "little") + (end[own] - begin[own]).astype("<u4").tobytes() + text))
        return _sent(out)

    def sent_runs(c: Chunk, shard: np.ndarray, hot: np.ndarray):
        """Begin, end and bucket of what goes to the suffix arrays, and the hot runs that repeat one of this chunk."""
        begin, end, key, again = c.runs(hot)
        whole = [np.concatenate((x[shard], y[~again])) for x, y in ((c.begin, begin), (c.end, end), (c.key, key))]
        return whole[0], whole[1], X.bucket_of(whole[2], buckets, 64), (begin[again], end[again])

    def sort(table):
        rows = sorted(_rows(table), key=lambda r: r[1])
        out = [r for r in rows if r[2] == FLAGS2]
        texts = [r for r in rows if r[2] == TEXTS]
        if texts:
            t, starts = [], []
            size = 0
            for r in texts:
                m = int.from_bytes(r[3][:4], "little")
                counts = np.frombuffer(r[3], "<u4", m, 4).astype(np.int64)
                own = np.frombuffer(r[3], np.uint8, offset=4 + 4 * m)
                whole = counts + length - 1
                begin = np.cumsum(whole) - whole
                flat = np.repeat(size + begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                t.append(own)
                starts.append(flat)
                size += len(own)
            text, all_starts = np.concatenate(t), np.concatenate(starts)
            valid = np.zeros(size, bool)
            valid[all_starts] = True
            sa = suffix_array(text, length)
            plcp = common_prefixes(text, sa, length)
            # between two valid starts of the array the common prefix is the least of those passed
            joins = plcp[sa] >= length
            run = np.cumsum(~joins)
            ok = valid[sa]
            place, run = sa[ok], run[ok]
            edge = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
            least = np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(run)))) if len(run) else place
            gone = np.zeros(size, bool)
            gone[place] = place > least
            for r, s in zip(texts, starts):
                if (g := gone[s]).any():
                    out.append((r[0], r[1], REPLY3, X.bits_of(g)))
        return _sent(out)

    final = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))), ("kept", pa.binary())])

    def remove(key, table, replies):
        c = Chunk(table, length, gram)
        got = _rows(replies, ("bucket", "kind", "payload"))
        n, size = len(c.key), len(c.data)
        dup = np.zeros(size + length, np.int32)  # +1 where a run of repeated starts begins, -1 behind its last byte
        if flags := [p for _, k, p in got if k == FLAGS2]:
            repeat, shard, hot = X.flags_of(flags[0], 3 * n).reshape(3, n)
            np.add.at(dup, c.begin[repeat], 1)
            np.add.at(dup, c.end[repeat] + length - 1, -1)
            begin, end, bucket, again = sent_runs(c, shard, hot)
            np.add.at(dup, again[0], 1)
            np.add.at(dup, again[1] + length - 1, -1)
            single = []
            for b, k, p in got:
                if k == REPLY3:
                    own = bucket == b
                    place = np.concatenate([np.arange(i, j) for i, j in zip(begin[own], end[own])])
                    single.append(place[X.flags_of(p, len(place))])
            if single:
                s = np.concatenate(single)
                np.add.at(dup, s, 1)
                np.add.at(dup, s + length, -1)
        gone = np.cumsum(dup[:size]) > 0
        spans, kept, removed = [], [], []
        for i, text in enumerate(c.texts):
            g = gone[c.stops[i] - c.lens[i] : c.stops[i]]
            if g.any():
                e = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"b": int(b), "e": int(x)} for b, x in zip(e[::2], e[1::2])])
                kept.append(np.frombuffer(text, np.uint8)[~g].tobytes())
            else:
                spans.append([])
                kept.append(text)
            removed.append(len(text) - len(kept[-1]))
        return pa.Table.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.lens), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, final.field("spans").type), pa.array(kept, pa.binary())], schema=final)

    by_chunk = held.groupBy("chunk")
    seen = by_chunk.applyInArrow(send_keys, SENT).groupBy("bucket").applyInArrow(common, SENT)
    contents = by_chunk.cogroup(seen.groupBy("chunk")).applyInArrow(send_contents, SENT)
    known = contents.groupBy("bucket").applyInArrow(firsts, SENT)
    texts = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send_texts, SENT)
    sorted_ = texts.groupBy("bucket").applyInArrow(sort, SENT)
    return by_chunk.cogroup(sorted_.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<b:long,e:long>>, kept binary")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, bytes]]:
    """The definition byte by byte, for tests: n_bytes, n_removed, n_spans, kept."""
    seen: set[bytes] = set()
    out = {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                gone[i : i + length] = True
            seen.add(k)
        g = gone[:-1]
        out[d] = (len(b), int(g.sum()), int((np.diff(gone[:-1].astype(int), prepend=0) == 1).sum()) if len(b) else 0, np.frombuffer(b, np.uint8)[~g].tobytes())
    return out
