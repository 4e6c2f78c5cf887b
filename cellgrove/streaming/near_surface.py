"""Extension: near-surface means kept up to date over arriving points, exact in any order and batching.

A higher point changes which older points count, so means don't merge. The state of a cell is its surface and, for each
height within the band below it, the counts and sums of the points there; a rising surface drops what falls out of the
band for good. State is bounded by the distinct heights in a band, not by the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import TOP_SURFACE
from ..functions.scalar import f32
from ..operators.grid import Grid

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Surface(StatefulProcessor):
    """Rows of a cell (z and the values) to its surface_z, n and means, whenever any of them may have changed."""

    def __init__(self, values: list[str], band: float):
        self.values, self.band = values, np.float32(band)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("surface", "z float")
        self.heights = handle.getMapState("heights", "z float", "n long, sums array<double>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(rows)
        new = new[new.z.notna()].assign(z=lambda d: d.z.astype(np.float32))
        if not len(new):
            return
        before = np.float32(self.top.get()[0]) if self.top.exists() else None
        surface = new.z.max() if before is None else max(before, new.z.max())
        floor = np.float32(np.float32(surface) - self.band)
        held = {np.float32(k[0]): v for k, v in self.heights.iterator()} if before is not None else {}
        if before is None or surface > before:
            self.top.update((float(surface),))
            for z in [z for z in held if z < floor]:
                self.heights.removeKey((float(z),))
                del held[z]
        for z, group in new[new.z >= floor].groupby("z"):
            n, sums, counts = held.get(np.float32(z), (0, [0.0] * len(self.values), [0] * len(self.values)))
            sums = [float(a + group[v].sum()) for a, v in zip(sums, self.values)]
            counts = [int(a + group[v].notna().sum()) for a, v in zip(counts, self.values)]
            held[np.float32(z)] = (int(n + len(group)), sums, counts)
            self.heights.updateValue((float(z),), held[np.float32(z)])
        n = sum(v[0] for v in held.values())
        means = []
        for i in range(len(self.values)):
            count = sum(v[2][i] for v in held.values())
            means.append(sum(v[1][i] for v in held.values()) / count if count else None)
        yield pd.DataFrame([[*key, float(surface), n, *means]], columns=["r", "c", "surface_z", "n", *self.values])

    def close(self) -> None:
        pass


def means(points: DataFrame, grid: Grid, values: list[str], band: float = TOP_SURFACE) -> DataFrame:
    """A stream of points as a stream of r, c, surface_z, n and the means: the newest row of a cell is its state.

    Null heights don't count; null values don't count towards their mean. Needs the RocksDB state store (PROVIDER).
    """
    d = grid.with_index(points).select("r", "c", f32(F.col("z")).alias("z"), *[F.col(v).cast("double").alias(v) for v in values])
    schema = "r int, c int, surface_z float, n long, " + ", ".join(f"`{v}` double" for v in values)
    return d.groupBy("r", "c").transformWithStateInPandas(statefulProcessor=Surface(values, band), outputStructType=schema, outputMode="Update", timeMode="None")


def maintain(points: DataFrame, grid: Grid, values: list[str], folder: str, checkpoint: str, band: float = TOP_SURFACE):
    """Runs the available batches; each writes the cells that it touched under its number, so a repeated one changes nothing."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return means(points, grid, values, band).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each cell's newest row."""
    d = spark.read.option("basePath", folder).parquet(folder)
    kept = [c for c in d.columns if c not in ("r", "c", "epoch")]
    return d.groupBy("r", "c").agg(F.max_by(F.struct(*kept), "epoch").alias("v")).select("r", "c", "v.*")
