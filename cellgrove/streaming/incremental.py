"""Extension: extremes per cell kept up to date over arriving point files with Structured Streaming.

Highest and lowest z merge from batch to batch. Near-surface means do not (a higher point changes which older points
count), so the touched cells are listed for recomputation.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid


def extremes(points: DataFrame, grid: Grid) -> DataFrame:
    return grid.with_index(points).groupBy("r", "c").agg(F.max("z").alias("highest"), F.min("z").alias("lowest"), F.count(F.lit(1)).alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("r", "c").agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"), F.sum("n").alias("n"))


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells whose surface the new batch raised, or that it is the first to fill."""
    return new.join(old.select("r", "c", F.col("highest").alias("_h")), ["r", "c"], "left").where("_h is null or highest > _h").select("r", "c")


def maintain(stream: DataFrame, grid: Grid, folder: str, checkpoint: str):
    """Runs the available batches; each leaves a new version of the cells, so a repeated batch changes nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark, target = df.sparkSession, os.path.join(folder, f"v{epoch:08d}")
        now = extremes(df, grid)
        if epoch:
            now = merge(spark.read.parquet(os.path.join(folder, f"v{epoch - 1:08d}")), now)
        now.write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, folder: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, max(d for d in os.listdir(folder) if d.startswith("v"))))
