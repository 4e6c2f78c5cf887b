"""Shared helpers: token rules, lineage cuts, and ordered chunks of documents."""

from __future__ import annotations

import tempfile
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that the cluster names; a folder of our own only in local mode, where there is one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Computes a DataFrame once and keeps it in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tie() -> Column:
    """The hash of a text that orders rows of one doc_id: 31 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33)


def ordered(ids: list[int | None], texts: list[bytes]) -> list[int]:
    """The places of rows in order: by id, without one last; equal ids by the hash of the text, then by the text."""
    times = Counter(ids)
    own = lambda t: (xxhash.xxh64_intdigest(t, 42) >> 33, t)
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, *(own(texts[i]) if times[ids[i]] > 1 else ())))


def chunk_of(docs: DataFrame, target_bytes: int = 4 << 20, least: int = 32, bins: int = 2048) -> tuple[Column, int, int]:
    """A column that numbers chunks of about target_bytes in ascending doc_id order, the number of chunks, and all bytes.

    Chunks are ranges of doc_id. The driver sees the bytes of at most `bins` equal ranges and splits each evenly; ranges
    that are filled unevenly (the worst 64 of a level) get their own, tighter ranges, so ids far apart from all others
    don't matter. One id with more than a chunk of rows, and rows without an id, are split by a hash of the text; rows
    without an id come last. Within equal ids the order is by that hash, then by text (see `ordered`).
    """
    b = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    key = F.col("doc_id").cast("decimal(20,0)")
    hashed = tie() / F.lit(float(1 << 31))
    lo, hi, total, loose = docs.agg(F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(b), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), b)), F.lit(0))).first()
    target = max(1, min(target_bytes, total // least))

    def measured(lo: int, hi: int, depth: int) -> tuple[int, int, list]:
        """(lo, width, for each bin its bytes or a range of its own)."""
        width = max(1, -(-(hi - lo + 1) // bins))
        off = key - F.lit(lo).cast("decimal(20,0)")
        at, sub = F.floor(off / F.lit(width)).cast("int"), F.floor(off * 16 / F.lit(width)).cast("long")
        inside = docs.where(key.between(F.lit(lo).cast("decimal(20,0)"), F.lit(hi).cast("decimal(20,0)")))
        fine = inside.groupBy(at.alias("at"), sub.alias("sub")).agg(F.sum(b).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        rows = {r[0]: r[1:] for r in fine.groupBy("at").agg(F.sum("b"), F.max("b"), F.min("lo"), F.max("hi")).collect()}
        out: list = [0] * ((hi - lo) // width + 1)
        for i, (size, _, _, _) in rows.items():
            out[i] = size
        if width > 1 and depth < 8:
            uneven = sorted((-r[1], i) for i, r in rows.items() if r[0] > 4 * target and 4 * r[1] > r[0])[:64]
            for _, i in uneven:
                out[i] = measured(rows[i][2], rows[i][3], depth + 1)
        return lo, width, out

    count, room = 0, 0  # chunks that are full, bytes in the one being filled

    def numbered(lo: int, width: int, sizes: list) -> Column:
        nonlocal count, room
        first, parts, inner = [], [], {}
        for i, size in enumerate(sizes):
            if isinstance(size, tuple):
                count, room = count + (room > 0), 0
                inner[i] = numbered(*size)
                count, room = count + (room > 0), 0
                first.append(0)
                parts.append(1)
            elif size >= target:
                count, room = count + (room > 0), 0
                first.append(count)
                parts.append(-(-size // target))
                count += parts[-1]
            else:
                if room and room + size > target:
                    count, room = count + 1, 0
                first.append(count)
                parts.append(1)
                room += size
        as_array = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<int>")
        off = key - F.lit(lo).cast("decimal(20,0)")
        at = F.floor(off / F.lit(width)).cast("int")
        share = hashed if width == 1 else F.pmod(off, F.lit(width)).cast("double") / F.lit(float(width))
        k = F.get(as_array(parts), at)
        out = F.get(as_array(first), at) + F.least(F.floor(share * k), k - 1).cast("int")
        for i, c in inner.items():
            out = F.when(at == i, c).otherwise(out)
        return out

    chunk = numbered(*measured(lo, hi, 0)) if lo is not None else F.lit(0)
    count += room > 0
    spare = max(1, -(-loose // target))
    last = F.lit(count) + F.least(F.floor(hashed * spare), F.lit(spare - 1)).cast("int")
    return F.when(F.col("doc_id").isNull(), last).otherwise(chunk).cast("int"), count + spare, int(total)


def keyed(docs: DataFrame) -> DataFrame:
    """id and doc (a struct of all columns): id is doc_id where it is unique, else a number above all doc_ids.

    Rows that share a doc_id or have none are kept once, as their numbers must not change; usually there are none.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    of = F.col("doc_id").cast("long")
    repeated = settle(docs.where("doc_id is not null").groupBy(of.alias("again")).count().where("count > 1").select("again"))
    most, nameless = docs.agg(F.coalesce(F.max(of), F.lit(0)), F.count_if(of.isNull())).first()
    if not nameless and repeated.isEmpty():
        return docs.select(of.alias("id"), doc)
    packed = docs.select(of.alias("id"), doc)
    twice = packed.join(repeated, F.col("id") == F.col("again"), "left_semi").unionByName(packed.where("id is null"))
    numbered = settle(twice.withColumn("id", F.lit(most + 1) + F.monotonically_increasing_id()))
    return packed.where("id is not null").join(repeated, F.col("id") == F.col("again"), "left_anti").unionByName(numbered)
