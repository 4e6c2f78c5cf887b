"""Document fingerprints: threshold-scaled sketches of byte shingles."""

from __future__ import annotations

import base64
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_of, settle, tie
from .exchange import mix

#: Bytes of a shingle, and the fixed fraction of all hashes that a sketch keeps: 1 in 2 ** FRACTION_BITS.
SHINGLE = 12
FRACTION_BITS = 4
#: Texts with fewer shingles keep all hashes, as too few may lie below the threshold.
SHORT = 64
#: Codes of the smaller sketch from which a likeness is estimated; with fewer, whole shingle sets are compared.
ENOUGH = 8


class Sketch(NamedTuple):
    """Sorted distinct codes: whole hashes where all are kept, else the 32 bits of those below the threshold."""

    whole: bool
    codes: np.ndarray

    def thinned(self) -> np.ndarray:
        """The codes below the threshold."""
        if not self.whole:
            return self.codes
        low = self.codes[self.codes < np.uint64(1 << (64 - FRACTION_BITS))]
        return np.unique(low >> np.uint64(32 - FRACTION_BITS)).astype("<u4")


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, and how many each has; a text shorter than a shingle is one shingle."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t + bytes(SHINGLE) for t in texts) + bytes(8), np.uint8)
    start = np.concatenate(([0], np.cumsum(lens + SHINGLE)))[:-1]
    v = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()
    h = mix(v[:-4] * np.uint64(0x9E3779B97F4A7C15) + mix(v[4:]))[: int((lens + SHINGLE).sum())]
    count = np.where(lens == 0, 0, np.maximum(lens - SHINGLE + 1, 1))
    at = np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)
    return h[at], count


def sketches(texts: list[bytes]) -> list[Sketch]:
    """The sketch of each text; only empty texts have sketches without codes, but for long ones of very few shingles."""
    h, count = _hashes(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    low = h < np.uint64(1 << (64 - FRACTION_BITS))
    keys = np.unique((doc[low].astype(np.uint64) << np.uint64(32)) | (h[low] >> np.uint64(32 - FRACTION_BITS)))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    ends = np.cumsum(count)
    return [Sketch(True, np.unique(h[e - n : e])) if n < SHORT else Sketch(False, (keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")) for a, b, e, n in zip(cut[:-1], cut[1:], ends, count)]


def encode(sketch: Sketch) -> str:
    return ("=" if sketch.whole else "<") + base64.b64encode(sketch.codes.tobytes()).decode()


def decode(text: str) -> Sketch:
    whole = text[0] == "="
    return Sketch(whole, np.frombuffer(base64.b64decode(text[1:]), "<u8" if whole else "<u4"))


def merge(*parts: Sketch) -> Sketch:
    """The sketch of texts taken together (but for shingles across the joint): whole where all parts are."""
    if all(p.whole for p in parts):
        return Sketch(True, np.unique(np.concatenate([p.codes for p in parts])))
    return Sketch(False, np.unique(np.concatenate([p.thinned() for p in parts])))


def likeness(a: Sketch, b: Sketch) -> float | None:
    """Containment of the smaller sketch in the larger, at the coarser scale of the two; 1 for two empty texts, 0 for one.

    None where the smaller has too few codes at that scale to tell: then the texts' whole sets must be compared."""
    if a.whole and b.whole:
        return _contained(a.codes, b.codes)
    if not (len(a.codes) or a.whole is False) or not (len(b.codes) or b.whole is False):
        return 0.0
    x, y = a.thinned(), b.thinned()
    return _contained(x, y) if min(len(x), len(y)) >= ENOUGH else None


def _contained(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


def compared(a: bytes, b: bytes, x: Sketch, y: Sketch) -> float:
    """The likeness of two texts by their sketches, or by their whole shingle sets where the sketches can't tell."""
    known = likeness(x, y)
    return known if known is not None else _contained(*(np.unique(_hashes([t])[0]) for t in (a, b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every document; null text counts as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(s) for s in sketches([t or b"" for t in b.column(1).to_pylist()])])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


FINAL = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _to_the_chunk_before(top: DataFrame, together: int = 4096) -> DataFrame:
    """Each h of (chunk, h) goes to the next smaller chunk that there is, the smallest chunk's to the largest.

    Neighbours are found among numbers only: within groups of chunks, then among the groups' first and last."""
    ids = top.select("chunk", F.floor(F.col("chunk") / together).alias("g"))
    last = ids.groupBy("g").agg(F.max("chunk").alias("most"))
    w = Window.partitionBy(F.lit(0)).orderBy("g")
    last = last.select(F.col("g").alias("of"), F.coalesce(F.lag("most").over(w), F.max("most").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior"))
    inner = ids.withColumn("own", F.lag("chunk").over(Window.partitionBy("g").orderBy("chunk")))
    before = inner.join(last, F.col("g") == F.col("of")).select(F.col("chunk").alias("to"), F.coalesce("own", "prior").alias("from_chunk"))
    return before.join(top, F.col("from_chunk") == F.col("chunk")).select(F.col("to").alias("chunk"), "h")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document in descending doc_id.

    The documents are dealt by ranges of doc_id and sorted within them, once; the first document of each range also
    goes to the end of the range before it, so no task sees more than its range. Null text: empty. Equal doc_ids go by
    a descending hash of the text, then by descending text; null doc_ids come first. A lone document
    is its own next. An empty table gives no rows. Further columns are ignored.
    """
    chunk, n_chunks, _ = chunk_of(docs)
    held = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), tie().alias("tie"), F.coalesce("text", F.lit("")).alias("text"))

    def heads(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            for c, d, o, t in zip(*(x.to_pylist() for x in b.columns)):
                key = (d is None, d or 0, o, t)
                if c not in best or key > best[c]:
                    best[c] = key
        cs = sorted(best)
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int32()), *(pa.array([best[c][k] for c in cs], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.string())))], names=["chunk", "n", "d", "tie", "text"])

    top = held.mapInArrow(heads, "chunk int, n boolean, d long, tie long, text string").groupBy("chunk").agg(F.max(F.struct("n", "d", "tie", "text")).alias("h"))
    top = settle(top)
    tails = _to_the_chunk_before(top).select("chunk", F.col("h.d").alias("doc_id"), F.col("h.tie").alias("tie"), F.col("h.text").alias("text"), F.lit(0).alias("real"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // 4))
    dealt = held.withColumn("real", F.lit(1)).unionByName(tails).repartition(parts, "chunk").sortWithinPartitions("chunk", F.desc("real"), F.col("doc_id").desc_nulls_first(), F.desc("tie"), F.desc("text"))

    def run(batches):
        held_row = None
        for b in batches:
            size, rows = 0, [held_row] if held_row else []
            for r in zip(*(x.to_pylist() for x in b.columns)):
                rows.append(r)
                size += len(r[2])
                if size > 4 << 20:
                    yield from edited(rows)
                    rows, size = rows[-1:], 0
            yield from edited(rows)
            held_row = rows[-1] if rows else held_row

    def edited(rows):
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i][3]]
        if not pairs:
            return
        texts = [r[2] for r in rows]
        raw, ed = [t.encode() for t in texts], []
        for i, j in pairs:
            half = len(texts[i]) // 2
            ed.append((texts[i][: len(texts[i]) - half] + texts[j][:half]).encode())
        sk, es = sketches(raw), sketches(ed)
        near_edited = [compared(raw[i], e, sk[i], x) for (i, _), e, x in zip(pairs, ed, es)]
        near_next = [compared(raw[i], raw[j], sk[i], sk[j]) for i, j in pairs]
        columns = [[rows[i][1] for i, _ in pairs], [len(texts[i]) for i, _ in pairs], [hashlib.sha256(e).hexdigest() for e in ed], [encode(sk[i]) for i, _ in pairs], [encode(e) for e in es], near_edited, near_next]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, FINAL.types)], schema=FINAL)

    return dealt.select("chunk", "doc_id", "text", "real").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
