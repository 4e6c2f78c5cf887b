"""Benchmark decontamination by a stored positional inverted index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import settle

SEPARATORS = bytes(c for c in range(128) if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c)
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TABLE = bytes(32 if FOLD[c] in SEPARATORS else FOLD[c] for c in range(256))
WINDOW = 10
#: Words by which a proximity match may be longer than its window.
SLOP = 2
#: Text bytes that one shard of the index covers.
SHARD_BYTES = 4 << 20
#: Bits of the filter of terms that the workers get: of this size however many terms there are.
FILTER_BITS = 24
POSTINGS = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("begin", pa.binary()), ("n", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
INDEX = "shard long, ids array<long>, begin binary, n binary, terms binary, counts binary, places binary"
FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), ("exact", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])


def words(text: bytes) -> list[bytes]:
    """Lower-cased A-Z, then runs of [0-9a-z] and non-ASCII."""
    return text.translate(TABLE).split()


def term_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its 64-bit hash, by which the index knows a term."""
    raw = data.translate(TABLE) + b" "
    edge = np.diff(np.concatenate(([True], np.frombuffer(raw, np.uint8) == 32)).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return begin, X.word_hashes(raw, begin, end)


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, w: term hashes in order) of all items, and which items have them (wid, item)."""

    def run(batches):
        for b in batches:
            out: dict[tuple[str, bytes], None] = {}
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = term_hashes(t or b"")[1]
                for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                    out[item, h[i : i + window].tobytes()] = None
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary())], names=["item", "w"])

    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("t"))
    pairs = settle(named.mapInArrow(run, "item string, w binary").distinct())
    ids = settle(pairs.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return ids, pairs.join(ids, "w").select("wid", "item")


def term_filter(wins: DataFrame) -> np.ndarray:
    """The terms of the windows as a bitmap of fixed size; a term too many only makes the index larger."""

    def run(batches):
        for b in batches:
            h = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(5)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(31))).astype(np.int64))], names=["at", "bit"])

    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in wins.select("w").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit")).collect():
        bits[r[0]] = r[1]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def build_index(docs: DataFrame, terms: np.ndarray | None = None, shortest: int = 1, slop: int = SLOP, longest: int = WINDOW) -> DataFrame:
    """The postings of docs, a row per shard of about SHARD_BYTES of text: its terms, and the places of each in order.

    terms: a filter (see term_filter) of the terms worth storing, else all; of these only places in spans of
    shortest + slop words that hold `shortest` of them, as no match of so many terms can lie elsewhere. A table of this
    form answers any benchmark made of those terms, in windows of `shortest` to `longest`, without reading the texts
    again. Null text: no words.
    """
    given = docs.sparkSession.sparkContext.broadcast(terms)

    def shard(rows, number):
        ids, texts = [r[0] for r in rows], [r[1] or b"" for r in rows]
        begin, h = term_hashes(b" ".join(texts))
        stops = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(begin, np.concatenate(([0], stops)))  # words before each document
        n = np.diff(upto)
        first = upto[:-1] + np.arange(len(n)) * (longest + slop)  # documents lie apart, so no span crosses them
        place = np.arange(len(h)) + np.repeat(first - upto[:-1], n)
        keep = given.value[h >> np.uint64(64 - FILTER_BITS)] if given.value is not None else np.ones(len(h), bool)
        size, width = int(first[-1] + n[-1]) + shortest + slop, shortest + slop
        inside = np.zeros(size + 1, np.int32)
        inside[place[keep] + 1] = 1
        sums = np.cumsum(inside)
        full = np.flatnonzero(sums[width:] - sums[:-width] >= shortest)
        mark = np.zeros(size + width + 1, np.int32)
        mark[full] += 1
        np.add.at(mark, full + width, -1)
        keep &= (np.cumsum(mark) > 0)[place]
        h, place = h[keep], place[keep]
        order = np.argsort(h, kind="stable")
        t, at, counts = np.unique(h[order], return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (first.astype("<i8"), n.astype("<i8"), t, counts.astype("<i4"), place[order].astype("<i4")))], schema=POSTINGS)

    def run(batches):
        number, rows, size = TaskContext.get().partitionId() << 20, [], 0
        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append(r)
                size += len(r[1] or b"")
                if size >= SHARD_BYTES or len(rows) == 1 << 19:
                    yield shard(rows, number)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield shard(rows, number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, INDEX)


def _starts(lists: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """Where the terms stand at their offsets: offset-adjusted lists intersected from the rarest on."""
    start = None
    for o in offsets[np.argsort([len(lists[o]) for o in offsets], kind="stable")]:
        shifted = lists[o] - o
        if start is None:
            start = shifted
        elif len(start) * 8 < len(shifted):
            start = start[X.member(shifted, start) >= 0]
        else:
            start = np.intersect1d(start, shifted, assume_unique=True)
        if not len(start):
            break
    return start


def _near(lists: list[np.ndarray], w: np.ndarray, slop: int) -> np.ndarray:
    """Starts of spans of len(w) + slop words that hold every term as often as the window does."""
    width = len(w) + slop
    _, own, times = np.unique(w, return_index=True, return_counts=True)
    rarest = np.argsort([len(lists[o]) for o in own], kind="stable")
    p = lists[own[rarest[0]]]
    s = np.unique((p[:, None] - np.arange(width)[None, :]).ravel())
    for r in rarest:
        q, m = lists[own[r]], int(times[r])
        i = np.searchsorted(q, s) + m - 1
        ok = i < len(q)
        ok[ok] = q[i[ok]] < s[ok] + width
        s = s[ok]
        if not len(s):
            break
    return s


def search(index: DataFrame, wins: DataFrame, slop: int = SLOP) -> DataFrame:
    """One row per indexed document: row, doc_id, n_words, spans (words in exact matches), exact, near (window ids).

    Every window goes only to the shards that hold its rarest term: counts of terms come from the index, joins bring
    windows and shards together. There the lists of its terms are intersected at their offsets, from the rarest on;
    near windows have all their terms, as often as they need them, within len + slop words; without slop none is sought.
    """

    def counted(batches):
        for b in batches:
            t = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            n = [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in t])), pa.array(np.concatenate(n).astype(np.int64))], names=["term", "shard", "c"])

    def cut(batches):
        for b in batches:
            ws = b.column(1).to_pylist()
            lens = [len(w) // 8 for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), lens)), pa.array(np.frombuffer(b"".join(ws), np.int64))], names=["wid", "term"])

    lists = index.select("shard", "terms", "counts").mapInArrow(counted, "term long, shard long, c long")
    needs = wins.select("wid", "w").mapInArrow(cut, "wid long, term long").distinct()
    held = settle(lists.join(needs.select("term").distinct(), "term"))
    known = needs.join(held.groupBy("term").agg(F.sum("c").alias("c")), "term", "left")
    rarest = known.groupBy("wid").agg(F.min_by("term", F.struct("c", "term")).alias("term"), F.bool_and(F.col("c").isNotNull()).alias("all")).where("all").select("wid", "term")
    asked = rarest.join(held.select("term", "shard"), "term").join(wins, "wid").select("shard", "wid", "w")

    def answer(key, shard, asked):
        r = {c: shard.column(c)[0].as_py() for c in POSTINGS.names}
        begin, n = np.frombuffer(r["begin"], "<i8"), np.frombuffer(r["n"], "<i8")
        terms, counts = np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], "<i4")
        places, edge = np.frombuffer(r["places"], "<i4").astype(np.int64), np.concatenate(([0], np.cumsum(counts)))
        hit = np.zeros(int(begin[-1] + n[-1]) + 1, np.int32)
        exact: dict[int, set[int]] = {}
        near: dict[int, set[int]] = {}
        for wid, raw in zip(asked.column("wid").to_pylist(), asked.column("w").to_pylist()):
            w = np.frombuffer(raw, np.uint64)
            at = X.member(terms, w)
            if (at < 0).any():
                continue
            own = [places[edge[i] : edge[i + 1]] for i in at]
            if slop:
                s = _near(own, w, slop)
                if not len(s):  # then there is no exact match either
                    continue
                # a span may reach before its document, never into the one before
                for d in np.unique(np.searchsorted(begin, s + len(w) + slop - 1, side="right") - 1).tolist():
                    near.setdefault(d, set()).add(wid)
            start = _starts(own, np.arange(len(w)))
            if len(start):
                np.add.at(hit, start, 1)
                np.add.at(hit, start + len(w), -1)
                for d in np.unique(np.searchsorted(begin, start, side="right") - 1).tolist():
                    exact.setdefault(d, set()).add(wid)
        hit = np.cumsum(hit) > 0
        spans = []
        for d in range(len(n)):
            e = np.flatnonzero(np.diff(np.concatenate(([0], hit[begin[d] : begin[d] + n[d]].view(np.int8), [0])))) if d in exact else []
            spans.append([{"b": int(x), "e": int(y)} for x, y in zip(e[::2], e[1::2])])
        row = (r["shard"] << 20) + np.arange(len(n))
        return pa.Table.from_arrays([pa.array(row), pa.array(r["ids"], pa.int64()), pa.array(n), pa.array(spans, FOUND.field("spans").type), *(pa.array([sorted(x.get(d, ())) for d in range(len(n))], pa.list_(pa.int64())) for x in (exact, near))], schema=FOUND)

    schema = "row long, doc_id long, n_words long, spans array<struct<b:int,e:int>>, exact array<long>, near array<long>"
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges hit), items and, with slop, near_items (sorted strings).

    An item_id on several benchmark rows is one item, with the windows of all its rows; rows without item_id are none.
    Null text or item: no words. Items with fewer words than a window are one window; items without words match nothing.
    Repeated documents stay repeated, a null doc_id is kept; empty tables give no rows or no hits; further columns are
    ignored. Every word of a text counts, however long it is.
    """
    wins, owners = windows(benchmark, window)
    shortest = wins.agg(F.min(F.octet_length("w"))).first()[0]
    index = settle(build_index(docs, term_filter(wins), (shortest or 8 * window) // 8, slop, window))
    found = settle(search(index, wins, slop))

    def named(kind: str, out: str) -> DataFrame:
        ids = found.select("row", F.explode(kind).alias("wid")).join(owners, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias(out))
        return ids.withColumnRenamed("row", f"of_{out}")

    none = F.array().cast("array<string>")
    d = found
    for kind, out in (("exact", "items"), ("near", "near_items"))[: 2 if slop else 1]:
        d = d.join(named(kind, out), F.col("row") == F.col(f"of_{out}"), "left").withColumn(out, F.coalesce(out, none))
    return d.select("doc_id", "n_words", "spans", "items", *(["near_items"] if slop else []))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with slop also n_near, the items in proximity."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["b"]))
    near = [F.size("near_items").cast("long").alias("n_near")] if slop else []
    d = find(docs, benchmark, window, slop)
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *near)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """The same result by comparing every window with every position, for tests."""
    out = {}
    wins = []
    for i, t in items:
        w = words((t or "").encode())
        wins += [(str(i), w[k : k + window]) for k in range(max(1, len(w) - window + 1)) if w and i is not None]
    for d, t in docs:
        w = words((t or "").encode())
        hit, ids = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    return out
