"""Sinks and file checks of the control plane."""

from __future__ import annotations

import hashlib
import json
import os
import struct
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(path: str, value) -> None:
    """Strict JSON: NaN and infinities are errors."""
    with open(path, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)


def create_json(path: str, value) -> None:
    """Creates the file, durably, or fails if there is one."""
    data = json.dumps(value, indent=2, sort_keys=True, allow_nan=False).encode()
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_table(df: DataFrame, path: str, cluster: tuple[str, ...] = ()) -> None:
    """Parquet, new only; clustered by the given columns so that scans can skip row groups."""
    (df.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else df).write.mode("errorifexists").parquet(path)


def clustered(points: DataFrame, side: int = 64) -> DataFrame:
    """Adds the coarse cell of (r, c) that tables are clustered by."""
    return points.withColumns({"block_r": F.floor(F.col("r") / side).cast("int"), "block_c": F.floor(F.col("c") / side).cast("int")})


def archive(folder: str, names: list[str]) -> str | None:
    """Moves those of the names that exist aside, into a dated folder; its path, or None."""
    there = [n for n in names if os.path.exists(os.path.join(folder, n))]
    if not there:
        return None
    aside = os.path.join(folder, "archive", datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ"))
    os.makedirs(aside)
    for n in there:
        os.rename(os.path.join(folder, n), os.path.join(aside, n))
    return aside


def sha256_file(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def blank_responses(points: DataFrame, key: str, empty: list[str]) -> DataFrame:
    return points.select(key, *[F.lit("").alias(c) for c in empty])


def tensor_shapes(path: str) -> dict[str, list[int]]:
    """Names and shapes in a safetensors file, from its header alone."""
    with open(path, "rb") as f:
        n = struct.unpack("<Q", f.read(8))[0]
        return {k: v["shape"] for k, v in json.loads(f.read(n)).items() if k != "__metadata__"}


def png(rows: int, cols: int, rgb: bytes) -> bytes:
    """An 8-bit RGB PNG without further libraries."""
    import zlib

    raw = b"".join(b"\0" + rgb[i * cols * 3 : (i + 1) * cols * 3] for i in range(rows))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def write_tiles(cells: DataFrame, folder: str, rows: int, cols: int, size: int = 1024, step: int = 768) -> DataFrame:
    """Writes red8, green8, blue8 of the cells as tile_r*_c*.png, on any store; path, bytes of each.

    A tile is one group, of bounded size. A task that runs again puts the same file into the same place.
    """
    import numpy as np
    import pandas as pd

    from ..operators.masks import tile_offsets
    from . import store

    offsets = lambda at, n: F.filter(tile_offsets(F.lit(n), size, step), lambda o: (o <= F.col(at)) & (F.col(at) < o + size))
    # the tiles of a cell follow from its place: four at most
    at = cells.withColumn("row0", F.explode(offsets("r", rows))).withColumn("col0", F.explode(offsets("c", cols)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.row0.iloc[0]), int(pdf.col0.iloc[0])
        h, w = min(size, rows - r0), min(size, cols - c0)
        image = np.zeros((h, w, 3), np.uint8)
        image[pdf.r - r0, pdf.c - c0] = pdf[["red8", "green8", "blue8"]].to_numpy()
        path = f"{folder}/tile_r{r0}_c{c0}.png"
        store.replace(path, data := png(h, w, image.tobytes()))
        return pd.DataFrame({"path": [path], "bytes": [len(data)]})

    return at.select("row0", "col0", "r", "c", "red8", "green8", "blue8").groupBy("row0", "col0").applyInPandas(run, "path string, bytes long")
