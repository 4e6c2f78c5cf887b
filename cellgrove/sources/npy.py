"""Arrays in npy files: written by ranges of rows, read by ranges of rows, each task its own."""

from __future__ import annotations

import os
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import ordinal
from . import store

TYPES = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "long", "u1": "smallint", "u2": "int", "b1": "boolean"}


def write_npy(df: DataFrame, path: str, columns: dict[str, str], key: str) -> None:
    """One npy file, new only, of a structured array: the columns (name: numpy type) in key order.

    The folder must be shared by all executors. The file is laid out first; then tasks write their rows at their places,
    so that a task that runs again writes the same bytes.
    """
    dtype = np.dtype([(c, t) for c, t in columns.items()])
    if os.path.exists(path):
        raise FileExistsError(path)
    np.lib.format.open_memmap(path, "w+", dtype, (df.count(),)).flush()

    def run(batches):
        n, whole = 0, None
        for b in batches:
            if b.num_rows:
                whole = np.lib.format.open_memmap(path, "r+") if whole is None else whole
                at, rows = b.column(0).to_numpy(), np.empty(b.num_rows, dtype)
                for i, c in enumerate(columns):
                    rows[c] = b.column(i + 1).to_numpy(zero_copy_only=False)
                whole[at] = rows
                n += b.num_rows
        if whole is not None:
            whole.flush()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    ordinal(df, key, "_o").select("_o", *columns).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _array_head(f) -> tuple[np.dtype, tuple[int, ...]]:
    """Element type and shape, read from the beginning of an npy file, which must be in row-major order."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran:
        raise ValueError("an array in column-major order")
    return dtype, shape


def _head(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """Element type, shape and place of the first element of an npy file."""
    with store.reader(path) as f:
        return *_array_head(f), f.tell()


def _frame(spark: SparkSession, dtype: np.dtype, shape: tuple[int, ...], rows: int, parts: int, pieces) -> DataFrame:
    """position and fields; pieces(k, n) yields the bytes of part k in pieces of whole elements, n elements in all."""
    size = int(np.prod(shape))
    fields = {c: dtype[c] for c in dtype.names} if dtype.names else {"value": dtype}
    schema = "position long, " + ", ".join(f"`{c}` {TYPES[t.str[1:]]}" for c, t in fields.items())

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                at = k * rows
                for data in pieces(k, min(rows, size - at)):
                    part = np.frombuffer(data, dtype)
                    cols = [part[c] if part.dtype.names else part for c in fields]
                    kinds = [pa.int16() if c.dtype == np.uint8 else pa.int32() if c.dtype == np.uint16 else None for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), *(pa.array(np.ascontiguousarray(c), t) for c, t in zip(cols, kinds))], names=["position", *fields])
                    at += len(part)

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, schema)


def read_npy(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """position and the fields of a structured array, or `value` of a plain one (row-major), by byte ranges of any store."""
    dtype, shape, offset = _head(path)
    return _frame(spark, dtype, shape, rows, -(-int(np.prod(shape)) // rows), lambda k, n: [store.read(path, offset + k * rows * dtype.itemsize, n * dtype.itemsize)])


def npz_shapes(path: str) -> dict[str, tuple[int, ...]]:
    """The names and shapes of a bundle's arrays."""
    with store.reader(path) as f, zipfile.ZipFile(f) as z:
        out = {}
        for n in z.namelist():
            with z.open(n) as m:
                out[n.removesuffix(".npy")] = _array_head(m)[1]
        return out


def read_npz(spark: SparkSession, path: str, name: str, rows: int = 1_000_000) -> DataFrame:
    """An array of an npz bundle like read_npy. Stored arrays are read by byte ranges; a compressed one, which has no
    places to begin at, is streamed by one task, `rows` elements at a time."""
    with store.reader(path) as f, zipfile.ZipFile(f) as z:
        info = z.getinfo(f"{name}.npy")
        with z.open(info) as m:
            dtype, shape = _array_head(m)
            head = m.tell()
    size = int(np.prod(shape))
    if info.compress_type == zipfile.ZIP_STORED:
        names = struct.unpack("<HH", store.read(path, info.header_offset + 26, 4))
        offset = info.header_offset + 30 + sum(names) + head
        return _frame(spark, dtype, shape, rows, -(-size // rows), lambda k, n: [store.read(path, offset + k * rows * dtype.itemsize, n * dtype.itemsize)])

    def streamed(k, n):
        with store.reader(path) as f, zipfile.ZipFile(f) as z, z.open(info.filename) as m:
            m.read(head)
            for at in range(0, size, rows):
                yield m.read(min(rows, size - at) * dtype.itemsize)

    return _frame(spark, dtype, shape, max(size, 1), min(size, 1), streamed)


def write_npz(path: str, files: dict[str, str], block: int = 1 << 20) -> None:
    """A new bundle of npy files (name: path), stored as they are, so that its arrays can be read by ranges; one block
    of bytes is held at a time. For small arrays numpy's own savez does."""
    if store.exists(path):
        raise FileExistsError(path)
    fs, at = store.resolve(path)
    with fs.open_output_stream(f"{at}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, file in files.items():
            with store.reader(file) as f, z.open(f"{name}.npy", "w", force_zip64=True) as m:
                while data := f.read(block):
                    m.write(data)
    fs.move(f"{at}.part", at)


def write_grid(cells: DataFrame, path: str, rows: int, cols: int, values: dict[str, str]) -> None:
    """One npy file for each value (name: numpy type) of dense cells, as path/name.npy of shape rows x cols."""
    os.makedirs(path, exist_ok=True)
    place = cells.withColumn("_at", F.col("r").cast("long") * cols + F.col("c"))
    for name, kind in values.items():
        file = os.path.join(path, f"{name}.npy")
        if os.path.exists(file):
            raise FileExistsError(file)
        np.lib.format.open_memmap(file, "w+", np.dtype(kind), (rows, cols)).flush()

        def run(batches, file=file):
            whole = None
            for b in batches:
                whole = np.lib.format.open_memmap(file, "r+") if whole is None else whole
                whole.reshape(-1)[b.column(0).to_numpy()] = b.column(1).to_numpy(zero_copy_only=False)
            if whole is not None:
                whole.flush()
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

        place.select("_at", name).mapInArrow(run, "n long").count()


def read_grid(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """r, c and the named values of the files that write_grid made, met by place."""
    out, cols = None, _head(f"{path}/{names[0]}.npy")[1][1]
    for n in names:
        one = read_npy(spark, f"{path}/{n}.npy").withColumnRenamed("value", n)
        out = one if out is None else out.join(one, "position")
    return out.select((F.floor(F.col("position") / cols)).cast("int").alias("r"), (F.col("position") % cols).cast("int").alias("c"), *names)
