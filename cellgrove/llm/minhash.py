"""MinHash near-dedup with sequential Bayesian verification."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import settle
from .components import components, joined
from .substring import SPACE

BANDS, ROWS = 28, 4
#: Signature positions compared at a time, and the chance of a similar pair being pruned at one look.
BATCH = 16
MISS = 1e-6
BLOCK = 1024
BASE = 0x9E3779B97F4A7C15
LEADER_ROUNDS = 1
_A = X.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_B = X.mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text, and where each text's begin (one more than texts)."""
    texts = [t.lower() for t in texts]
    raw = b" ".join(texts) + b" "
    space = SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = X.word_hashes(raw, begin, end)
    bounds = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    h = X.range_hash(X.prefix(words), at, at + np.minimum(n, width)[doc])
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS minima for each non-empty set."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    if not len(out):
        return out
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(((h * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), at[:-1])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(7), v.shape[:2])
    for i in range(ROWS):
        key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
    return key.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(positions compared, matches needed): fewer leave a posterior chance under `miss` of similarity >= threshold.

    With a uniform prior the posterior after m matches in n is Beta(m+1, n-m+1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survive(a: np.ndarray, b: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of a and b still may be similar: a batch of positions at a time, the hopeless leave early."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in needs:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(1)
        keep = matches >= m
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _sig(col: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint32).reshape(len(col), BANDS * ROWS)


def _small(col: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), BANDS * ROWS)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), cid (a hash of the set; null without shingles), sig."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (size < 1 << 20 or stop == at):
                    size += len(texts[stop] or b"")
                    stop += 1
                h, cut = shingle_sets([t or b"" for t in texts[at:stop]], width)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                sig = signatures(h, np.concatenate((cut[:-1][full], [len(h)])))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
                key = X.mix(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64) * np.uint64(BASE)).view(np.int64)
                sigs: list = [None] * (stop - at)
                for i, s in zip(full.tolist(), sig):
                    sigs[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:stop], pa.int64()), pa.array(n), pa.array(key, mask=n == 0), pa.array(sigs, pa.binary())], names=["doc_id", "n", "cid", "sig"])
                at = stop

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, n long, cid long, sig binary")


def _prune(pairs: DataFrame, sigs: DataFrame, needs) -> DataFrame:
    """The pairs (u, v) whose signatures leave a chance."""

    def run(batches):
        for b in batches:
            keep = survive(_small(b.column(2).to_pylist()), _small(b.column(3).to_pylist()), needs) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    d = pairs.join(sigs.select(F.col("cid").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("cid").alias("v"), F.col("sig").alias("sv")), "v")
    return d.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = X.unpack(x), X.unpack(y)
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = int((X.member(x, y) >= 0).sum())
                    if den * both >= num * (len(x) + len(y) - both):
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])

    d = pairs.join(sets.select(F.col("cid").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("cid").alias("v"), F.col("s").alias("sv")), "v")
    return d.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Band rows (k, cid) of the buckets that still hold several components, with `root`."""
    if roots is None:
        return rows.withColumn("root", F.col("cid"))
    d = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_keys = d.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("k")
    return d.join(open_keys, "k")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents are linked when den * intersection >= num * union of their sets of distinct `width`-word shingles
    (A-Z lower-cased; fewer words: one shingle; none: an empty set, never linked).
    1. Equal sets are one class from the start, however many documents share them. 2. Classes meet in the buckets of
    BANDS bands of ROWS minima; a pair at the threshold meets nowhere with a chance of 4e-7. 3. In each bucket
    everything is compared with one leader, first by signature batches that prune pairs whose posterior chance of
    being similar is under MISS, then exactly on full sets; further rounds, if any, take other leaders in the buckets
    that still hold several components. 4. What still lies in one bucket but in different components is compared in blocks,
    pair by pair, so that no link between components is lost; within a component no further link can change anything.
    Rows without doc_id are not linked and have a null component and kept = false. Rows with equal doc_id are separate
    rows of that name. An empty table gives no rows; further columns are ignored.
    """
    needs = least_matches(num / den)
    s = settle(sketch(docs, width))
    named = s.where("doc_id is not null and cid is not null")
    classes = settle(named.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))

    def explode(batches):
        for b in batches:
            if b.num_rows:
                k = bands(_sig(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["k", "cid"])

    every = classes.select("cid", "sig").mapInArrow(explode, "k long, cid long")
    shared = every.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = settle(every.join(shared.select("k"), "k"))
    sigs = _bytes(classes)
    met = rows.select("cid").distinct().join(classes.select("cid", "rep"), "cid")
    texts = docs.select("doc_id", "text").join(met.withColumnRenamed("rep", "doc_id"), "doc_id").select("cid", "text")
    # a doc_id may stand on several rows: only sets that are the class's own count
    sets = settle(_own(texts, width))
    roots = None
    for r in range(rounds + 1):
        now = _labelled(rows, roots)
        if r < rounds:
            leader = now.groupBy("k").agg(F.min_by("cid", F.xxhash64("cid", F.lit(r))).alias("l"), F.min_by("root", F.xxhash64("cid", F.lit(r))).alias("lr"))
            pairs = now.join(leader, "k").where("cid <> l and root <> lr").select(F.least("cid", "l").alias("u"), F.greatest("cid", "l").alias("v")).distinct()
            found = _verify(_prune(pairs, sigs, needs), sets, num, den)
        else:
            found = _across(now, sigs, sets, roots, needs, num, den)
        roots = settle(components(found) if roots is None else joined(roots, settle(found)))
    rep = classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    label = rep.groupBy("root").agg(F.min("rep").alias("component"))
    of = rep.join(label, "root").select(F.col("cid").alias("_cid"), "component")
    out = s.select("doc_id", "n", "cid").join(of, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _own(texts: DataFrame, width: int) -> DataFrame:
    """One packed set for each cid, from the rows whose text has that set."""

    def run(batches):
        for b in batches:
            cids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for at in range(0, len(cids), 256):
                part = cids[at : at + 256]
                h, cut = shingle_sets([t or b"" for t in texts[at : at + 256]], width)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
                key = X.mix(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(np.uint64) * np.uint64(BASE)).view(np.int64)
                own = np.flatnonzero(key == part)
                s = [X.pack(h[cut[i] : cut[i + 1]]) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array(s, pa.binary())], names=["cid", "s"])

    d = texts.select("cid", F.col("text").cast("binary").alias("t")).mapInArrow(run, "cid long, s binary")
    return d.dropDuplicates(["cid"])


def _across(now: DataFrame, sigs: DataFrame, sets: DataFrame, roots: DataFrame | None, needs, num: int, den: int) -> DataFrame:
    """Links (u, v) between classes of one bucket but different components, compared pair by pair.

    Each open bucket goes to its largest component, the hub, so that a component meets all its strangers in one place
    however many bands they share. Strangers meet the hub's members, and each other; the hub's members never meet. Both
    are cut into blocks of BLOCK, and each pair of blocks is a group of its own, so a hub of any size costs one row a
    member for each block of strangers. Signatures prune, full sets decide, and of the links found only those come out
    that join what the others don't.
    """
    if roots is None:
        d = now.withColumn("m", F.lit(1).cast("long"))
    else:
        size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
        d = now.join(size, "root", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    hub = d.groupBy("k").agg(F.max(F.struct("m", "root"))["root"].alias("hub"))
    d = settle(d.join(hub, "k").select("hub", "cid", "root").distinct())
    at_home = F.col("root") == F.col("hub")
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    n = d.groupBy("hub").agg(blocks(at_home).alias("homes"), blocks(~at_home).alias("others"))
    d = d.join(n, "hub").withColumn("home", at_home).withColumn("b", F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int"))
    upto = lambda c: F.transform(F.sequence(F.lit(0), F.col(c)), lambda x: x - 1)
    row = lambda mixed, i, j: F.struct(F.lit(mixed).alias("mixed"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_others = F.transform(F.filter(upto("others"), lambda x: x >= 0), lambda x: row(True, x, F.col("b")))
    with_homes = F.transform(F.filter(upto("homes"), lambda x: x >= 0), lambda x: row(True, F.col("b"), x))
    among = F.transform(F.filter(upto("others"), lambda x: x >= 0), lambda x: row(False, F.least("b", x), F.greatest("b", x)))
    d = d.withColumn("g", F.explode(F.when(F.col("home"), with_others).otherwise(F.concat(with_homes, among)))).select("hub", "g.*", "b", "home", "cid", "root")
    d = d.join(sigs, "cid").join(sets, "cid").select("hub", "mixed", "i", "j", "b", "home", "cid", "root", "sig", "s")

    def run(table):
        b, cid, root = (table.column(c).to_numpy() for c in ("b", "cid", "root"))
        mixed, i, j = (table.column(c)[0].as_py() for c in ("mixed", "i", "j"))
        home = np.array(table.column("home").to_pylist(), bool)
        sig = _small(table.column("sig").to_pylist())
        shingles = [X.unpack(x) for x in table.column("s").to_pylist()]
        lens = np.array([len(x) for x in shingles])
        _, flat = np.unique(np.concatenate(shingles), return_inverse=True)
        cut = np.concatenate(([0], np.cumsum(lens)))
        mark = np.zeros(len(flat) + 1, np.int32)
        up = {int(r): int(r) for r in root}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        us, vs = [], []
        for x in np.flatnonzero(~home):
            other = np.flatnonzero(home if mixed else (root != root[x]) & (cid > cid[x]) & ((i == j) | (b != b[x])))
            fits = (den * np.minimum(lens[other], lens[x]) >= num * np.maximum(lens[other], lens[x]))
            other = other[fits]
            if not len(other):
                continue
            other = other[survive(np.broadcast_to(sig[x], (len(other), sig.shape[1])), sig[other], needs)]
            if not len(other):
                continue
            mark[flat[cut[x] : cut[x + 1]]] = 1
            at = np.concatenate([flat[cut[y] : cut[y + 1]] for y in other])
            both = np.add.reduceat(mark[at], np.concatenate(([0], np.cumsum(lens[other])[:-1])))
            mark[flat[cut[x] : cut[x + 1]]] = 0
            for y in other[den * both >= num * (lens[x] + lens[other] - both)]:
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q:
                    up[p] = q
                    us.append(min(cid[x], cid[y]))
                    vs.append(max(cid[x], cid[y]))
        return pa.Table.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return d.groupBy("hub", "mixed", "i", "j").applyInArrow(run, "u long, v long")


def _bytes(sigs: DataFrame) -> DataFrame:
    """Signatures with the low byte of each position only: chance matches can spare a pair, never prune one."""

    def run(batches):
        for b in batches:
            small = (_sig(b.column(1).to_pylist()) & np.uint32(255)).astype(np.uint8) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in small], pa.binary())], names=["cid", "sig"])

    return sigs.select("cid", "sig").mapInArrow(run, "cid long, sig binary")


def brute_force(docs: list[tuple[int, str | None]], width: int, num: int = 80, den: int = 100) -> dict[int, tuple[int, int]]:
    """All pairs, for tests: n_shingles, component_id."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
