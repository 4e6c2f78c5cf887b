"""LAS 1.4 point format 8 files as a Spark data source: format("las") reads and writes, on any store of sources.store.

One input partition is a range of records of one file, so a file is read by many tasks. orig_index is the record's
place in its file plus the records of the files before it (in path order). A zone map (see `write_zones`) keeps the
bounds of each run of records, so filters on x, y, z and orig_index read only the runs that can match.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import store

RECORD = np.dtype([("x_raw", "<i4"), ("y_raw", "<i4"), ("z_raw", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("source_id", "<u2"), ("gps_time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2"), ("nir", "<u2")])
CORE = "orig_index long, x double, y double, z double, x_raw int, y_raw int, z_raw int, red int, green int, blue int, nir int, intensity int, return_number tinyint, number_of_returns tinyint, flags int, classification smallint, user_data smallint, scan_angle smallint, source_id int, gps_time double"
# The extra-bytes types of the published LAS 1.4 specification.
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
SQL_TYPES = {"u1": "smallint", "i1": "tinyint", "<u2": "int", "<i2": "smallint", "<u4": "long", "<i4": "int", "<u8": "decimal(20,0)", "<i8": "long", "<f4": "float", "<f8": "double"}
EXTRA_OF = {"smallint": 4, "tinyint": 2, "int": 6, "bigint": 8, "float": 9, "double": 10}
HEADER_BYTES, VLR_BYTES, EXTRA_BYTES = 375, 54, 192


class LasError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    offset: int
    record_length: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    extra: tuple[tuple[str, str], ...]
    crs: str | None = None  # the coordinate system's text
    other_crs: bool = False  # whether one is declared by keys instead

    @classmethod
    def parse(cls, data: bytes) -> Header:
        """data: the bytes before the first point record."""
        if data[:4] != b"LASF" or len(data) < HEADER_BYTES:
            raise LasError("no LAS 1.4 header")
        size, offset, n_vlr = struct.unpack_from("<HII", data, 94)
        fmt, length = struct.unpack_from("<BH", data, 104)
        if (data[24], data[25]) != (1, 4) or fmt & 0x3F != 8:
            raise LasError(f"version {data[24]}.{data[25]}, point format {fmt}: only 1.4 with 8 is read")
        box = struct.unpack_from("<6d", data, 179)
        extra, at, crs, keys = [], size, None, False
        for _ in range(n_vlr):
            user, record, n = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
            if user == b"LASF_Spec" and record == 4:
                for i in range(at + VLR_BYTES, at + VLR_BYTES + n, EXTRA_BYTES):
                    kind = data[i + 2]
                    if kind not in EXTRA_TYPES:
                        raise LasError(f"extra bytes of type {kind}")
                    extra.append((data[i + 4 : i + 36].rstrip(b"\0").decode(), EXTRA_TYPES[kind]))
            elif user == b"LASF_Projection" and record == 2112:
                crs = data[at + VLR_BYTES : at + VLR_BYTES + n].rstrip(b"\0").decode()
            elif user == b"LASF_Projection" and record == 34735:
                keys = True
            at += VLR_BYTES + n
        if clash := {n for n, _ in extra} & {c.split()[0] for c in CORE.split(", ")}:
            raise LasError(f"extra dimensions named like core fields: {sorted(clash)}")
        return cls(offset, length, struct.unpack_from("<Q", data, 247)[0], struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), box[1::2], box[::2], tuple(extra), crs, keys)

    @classmethod
    def read(cls, path: str) -> Header:
        with store.reader(path) as f:
            first = f.read(HEADER_BYTES)
            if len(first) < HEADER_BYTES or first[:4] != b"LASF":
                raise LasError(f"{path} has no LAS 1.4 header")
            return cls.parse(first + f.read(struct.unpack_from("<I", first, 96)[0] - HEADER_BYTES))

    @property
    def dtype(self) -> np.dtype:
        d = np.dtype([*RECORD.descr, *self.extra])
        rest = self.record_length - d.itemsize
        if rest < 0:
            raise LasError("records are shorter than their fields")
        return np.dtype([*d.descr, ("_pad", f"V{rest}")]) if rest else d

    @property
    def schema(self) -> str:
        return ", ".join([CORE, *(f"`{n}` {SQL_TYPES[t]}" for n, t in self.extra)])


def decode(data: bytes, header: Header, first: int) -> dict[str, np.ndarray]:
    """The columns of whole records."""
    p = np.frombuffer(data, header.dtype)
    out = {"orig_index": np.arange(first, first + len(p))}
    for i, a in enumerate("xyz"):
        out[a] = p[f"{a}_raw"] * header.scale[i] + header.shift[i]
    out["return_number"], out["number_of_returns"] = (p["returns"] & 15).astype(np.int8), (p["returns"] >> 4).astype(np.int8)
    return out | {n: p[n] for n in (*RECORD.names, *(n for n, _ in header.extra)) if n != "returns"}


def _batch(cols: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name]).cast(f.type) for f in schema], schema=schema)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    base: int


def paths_of(path: str) -> list[str]:
    found = store.files(path, ".las")
    if not found:
        raise LasError(f"no LAS file at {path}")
    return found


class LasSource(DataSource):
    """Options: path, chunk (records of a partition, default 1,000,000), limit (partitions), columns (comma-separated),
    zones (the folder of a zone map of the path); for writing see LasWriter."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        whole = Header.read(paths_of(self.options["path"])[0]).schema
        if wanted := self.options.get("columns"):
            by = {c.split()[0].strip("`"): c for c in whole.split(", ")}
            return ", ".join(by[n.strip()] for n in wanted.split(","))
        return whole

    def reader(self, schema):
        return LasReader(self.options, schema)

    def writer(self, schema, overwrite):
        return LasWriter(self.options, schema)


AXES = ("x", "y", "z", "orig_index")


class LasReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.wanted = options, schema
        self.box: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters):
        """Bounds of x, y, z and orig_index skip files by their headers and runs by a zone map; Spark applies all filters again."""
        for f in filters:
            at, v, kind = getattr(f, "attribute", None), getattr(f, "value", None), type(f).__name__
            if kind == "In" and f.value:
                v, kind = f.value, "In"
            if at and len(at) == 1 and at[0] in AXES and all(isinstance(x, (int, float)) for x in (v if kind == "In" else (v,))):
                lo, hi = self.box.get(at[0], (-float("inf"), float("inf")))
                low, high = (min(v), max(v)) if kind == "In" else (v, v)
                if at[0] == "orig_index":  # whole numbers: strict bounds are the next ones
                    low, high = low + (kind == "GreaterThan"), high - (kind == "LessThan")
                self.box[at[0]] = (max(lo, low) if kind.startswith(("Greater", "Equal", "In")) else lo, min(hi, high) if kind.startswith(("Less", "Equal", "In")) else hi)
            yield f

    def _meets(self, low, high) -> bool:
        """Whether records between low and high (x, y, z, orig_index) can pass the filters."""
        return all(low[AXES.index(a)] <= hi and high[AXES.index(a)] >= lo for a, (lo, hi) in self.box.items())

    def _runs(self, h: Header, base: int, zones: list[dict] | None, size: int) -> list[tuple[int, int]]:
        """Pieces (first, count) of a file that can hold what is asked for, of at most `size` records."""
        lo, hi = self.box.get("orig_index", (0, base + h.count))
        first, stop = int(max(0, lo - base)), int(min(h.count, hi - base + 1))
        if zones is None:
            return [(i, min(size, stop - i)) for i in range(first, stop, size)]
        out: list[tuple[int, int]] = []
        if sum(z["count"] for z in zones) != h.count or any(z["file_records"] != h.count for z in zones):
            raise LasError("the zone map is not of this file as it is")
        for z in zones:
            i, j = max(z["first"], first), min(z["first"] + z["count"], stop)
            if i < j and self._meets([z[f"{a}_low"] for a in "xyz"] + [base + i], [z[f"{a}_high"] for a in "xyz"] + [base + j - 1]):
                if out and sum(out[-1]) == i and out[-1][1] + j - i <= size:
                    out[-1] = (out[-1][0], j - out[-1][0])
                else:
                    out.append((i, j - i))
        return out

    def partitions(self):
        size, out, base = int(self.options.get("chunk", 1_000_000)), [], 0
        zones = load_zones(self.options["zones"]) if "zones" in self.options and self.box else None
        for p in paths_of(self.options["path"]):
            h = Header.read(p)
            if h.count and self._meets((*h.low, base), (*h.high, base + h.count - 1)):
                out += [Range(p, i, n, base) for i, n in self._runs(h, base, None if zones is None else zones.get(p, []), size)]
            base += h.count
        limit = self.options.get("limit")
        return out[: int(limit)] if limit else out

    def read(self, part: Range | None):
        """Record batches of one range; None stands for a scan whose every file is skipped."""
        if part is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, h = to_arrow_schema(self.wanted), Header.read(part.path)
        for first, data in _blocks(part.path, h, part.first, part.count):
            yield _batch(decode(data, h, part.base + first), schema)


def _blocks(path: str, h: Header, first: int, count: int, size: int = 200_000):
    """(first record, bytes) of a range of records, some at a time."""
    with store.reader(path) as f:
        for i in range(first, first + count, size):
            n = min(size, first + count - i)
            data = f.read_at(n * h.record_length, h.offset + i * h.record_length)
            if len(data) < n * h.record_length:
                raise LasError(f"{path} ends before record {i + n}")
            yield i, data


ZONES = "path string, file_records long, first long, count long, x_low double, x_high double, y_low double, y_high double, z_low double, z_high double"


def write_zones(spark: SparkSession, path: str, zones: str, run: int = 65_536, together: int = 64) -> None:
    """A zone map of LAS files, as Parquet in the new folder `zones`: the bounds of every `run` records.

    One pass over the records, by tasks of `together` runs; the map has a row for each run and is read where a scan is
    planned. Files are known by path and record count; a file that the map doesn't know is an error at the scan.
    """
    pieces = [(p, h.count, i, min(run * together, h.count - i)) for p in paths_of(path) for h in [Header.read(p)] for i in range(0, h.count, run * together)]

    def bounds(batches):
        for b in batches:
            for p, n, first, count in zip(*(c.to_pylist() for c in b.columns)):
                h, rows = Header.read(p), []
                for i, data in _blocks(p, h, first, count, run):
                    cols = decode(data, h, i)
                    rows.append((p, n, i, len(cols["x"]), *(float(v) for a in "xyz" for v in (cols[a].min(), cols[a].max()))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in ZONES.split(", ")])

    asked = spark.createDataFrame(pieces, "path string, file_records long, first long, count long").repartition(max(1, len(pieces)))
    asked.mapInArrow(bounds, ZONES).repartitionByRange(max(1, len(pieces) // 64), "path", "first").sortWithinPartitions("path", "first").write.mode("errorifexists").parquet(zones)


def load_zones(zones: str) -> dict[str, list[dict]]:
    """The runs of each file in a zone map, in order."""
    out: dict[str, list[dict]] = {}
    for f in store.files(zones, ".parquet"):
        for z in pq.read_table(store.reader(f)).to_pylist():
            out.setdefault(z["path"], []).append(z)
    return {p: sorted(v, key=lambda z: z["first"]) for p, v in out.items()}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def header_bytes(count: int, scale, shift, low, high, extra: list[tuple[str, int]]) -> bytes:
    size = RECORD.itemsize + sum(np.dtype(EXTRA_TYPES[k]).itemsize for _, k in extra)
    vlr = b""
    if extra:
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, EXTRA_BYTES * len(extra), b"extra dimensions")
        vlr += b"".join(struct.pack("<HBB32s156s", 0, k, 0, n.encode(), b"") for n, k in extra)
    h = bytearray(HEADER_BYTES)
    h[:4], h[24:26] = b"LASF", b"\x01\x04"
    struct.pack_into("<HIIBH", h, 94, HEADER_BYTES, HEADER_BYTES + len(vlr), bool(extra), 8, size)
    struct.pack_into("<3d3d", h, 131, *scale, *shift)
    struct.pack_into("<6d", h, 179, *[v for pair in zip(high, low) for v in pair])
    struct.pack_into("<Q", h, 247, count)
    return bytes(h) + vlr


class LasWriter(DataSourceArrowWriter):
    """Files of at most `records` points each, staged by task attempt and moved into place by one commit.

    Options: path, scale and offset (three numbers each, comma-separated), records (default 1,000,000). Columns beyond
    the core are extra dimensions. Without any point one file with no records is written.
    """

    def __init__(self, options, schema):
        triple = lambda k, d: tuple(map(float, options.get(k, d).split(",")))
        self.scale, self.shift = triple("scale", "0.001,0.001,0.001"), triple("offset", "0,0,0")
        self.records = int(options.get("records", 1_000_000))
        core = {c.split()[0] for c in CORE.split(", ")}
        self.extra = [(f.name, EXTRA_OF[f.dataType.simpleString()]) for f in schema if f.name not in core]
        self.staging = store.Staging.begin(options["path"])

    def write(self, iterator):
        dtype = np.dtype([*RECORD.descr, *((n, EXTRA_TYPES[k]) for n, k in self.extra)])
        names, held, count = [], [], 0
        for b in iterator:
            at = 0
            while at < b.num_rows:
                p = self._packed(b.slice(at, self.records - count), dtype)
                held.append(p)
                at, count = at + len(p), count + len(p)
                if count == self.records:
                    names.append(self._file(held, len(names)))
                    held, count = [], 0
        if held or not names:
            names.append(self._file(held or [np.zeros(0, dtype)], len(names)))
        return Written(names)

    def _packed(self, b: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        p = np.zeros(b.num_rows, dtype)
        for n in dtype.names:
            if n in cols:
                p[n] = cols[n]
        for i, a in enumerate("xyz"):
            if f"{a}_raw" not in cols:
                p[f"{a}_raw"] = np.round((cols[a] - self.shift[i]) / self.scale[i])
        if "return_number" in cols:
            p["returns"] = cols["return_number"].astype(np.uint8) | (cols["number_of_returns"].astype(np.uint8) << 4)
        return p

    def _file(self, held: list[np.ndarray], number: int) -> str:
        count = sum(map(len, held))
        raw = np.array([[[p[f"{a}_raw"].min(), p[f"{a}_raw"].max()] for a in "xyz"] for p in held if len(p)]).reshape(-1, 3, 2)
        ends = np.sort(raw * np.array(self.scale)[:, None] + np.array(self.shift)[:, None], axis=2) if count else np.zeros((1, 3, 2))
        low, high = ends[:, :, 0].min(0), ends[:, :, 1].max(0)
        header = header_bytes(count, self.scale, self.shift, low, high, self.extra)
        return self.staging.write([header, *(p.tobytes() for p in held)], number, f".{count}.las")

    def commit(self, messages):
        names = sorted(n for m in messages if m is not None for n in m.names)
        full = [n for n in names if not n.endswith(".0.las")] or names[:1]
        self.staging.commit([(n, f"part-{i:05d}.las") for i, n in enumerate(full)])

    def abort(self, messages):
        self.staging.abort()


def register(spark: SparkSession) -> None:
    """Makes format("las") known; the reader takes part in filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)


def from_binary(files: DataFrame, header: Header) -> DataFrame:
    """Points of whole files given as (path, content), for stores that only Spark reads; orig_index counts by file."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"path string, {header.schema}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                h = Header.parse(data[: struct.unpack_from("<I", data, 96)[0]])
                for i in range(0, h.count, 200_000):
                    n = min(200_000, h.count - i)
                    cols = decode(data[h.offset + i * h.record_length : h.offset + (i + n) * h.record_length], h, i)
                    yield _batch({"path": np.full(n, path, dtype=object)} | cols, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_subset(points: DataFrame, source: str, path: str) -> None:
    """Writes points of a LAS file under that file's own scale and shift, so their raw integers stay what they are."""
    h = Header.read(paths_of(source)[0])
    numbers = lambda xs: ",".join(map(repr, xs))
    points.write.format("las").option("path", path).option("scale", numbers(h.scale)).option("offset", numbers(h.shift)).mode("append").save()
