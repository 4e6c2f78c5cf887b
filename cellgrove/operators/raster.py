"""Per-cell aggregates. Each is one grouped aggregation with map-side partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_SURFACE
from ..functions.scalar import f32, to_8bit, yes
from .grid import Grid


def surface_max(indexed: DataFrame) -> DataFrame:
    """The highest float32 z of each occupied cell."""
    return indexed.groupBy("r", "c").agg(F.max(f32(F.col("z"))).alias("surface_z"))


def lowest(points: DataFrame, grid: Grid, out: str = "z") -> DataFrame:
    """The lowest z of each occupied cell of a (coarse) grid."""
    return grid.with_index(points, "_r", "_c").groupBy(F.col("_r").alias("r"), F.col("_c").alias("c")).agg(F.min("z").alias(out))


def near_surface(indexed: DataFrame, surface: DataFrame, grid: Grid, band: float = TOP_SURFACE) -> DataFrame:
    """The points within `band` below their cell's surface; compared in float32."""
    return grid.gather(indexed, surface).where(f32(F.col("z")) >= f32(F.col("surface_z") - f32(band)))


def near_surface_means(indexed: DataFrame, surface: DataFrame, grid: Grid, values: list[str], band: float = TOP_SURFACE) -> DataFrame:
    means = [F.avg(F.col(v).cast("double")).alias(v) for v in values]
    return near_surface(indexed, surface, grid, band).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), *means)


def stat_grid(indexed: DataFrame, grid: Grid, values: list[str], band: float = TOP_SURFACE) -> DataFrame:
    """All statistics of every cell in one wide table: surface_z, n, the means, and void (a cell without points)."""
    surface = surface_max(indexed)
    means = near_surface_means(indexed, surface, grid, values, band)
    return grid.dense(surface.join(means, ["r", "c"], "left")).withColumn("void", F.col("surface_z").isNull())


def void_rate(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("cells"), F.count_if("void").alias("void_cells"), F.avg(F.col("void").cast("double")).alias("void_rate"))


def rgb8(stats: DataFrame) -> DataFrame:
    return stats.select("r", "c", *[to_8bit(F.col(x)).alias(f"{x}8") for x in ("red", "green", "blue")])


def height_above(points: DataFrame, grid: Grid, terrain: DataFrame, value: str = "dtm") -> DataFrame:
    """Adds hag = float32(z - terrain of the point's cell)."""
    d = grid.with_index(points, "_r", "_c").join(terrain.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("_t")), ["_r", "_c"], "left")
    return d.withColumn("hag", f32(F.col("z") - F.col("_t"))).drop("_r", "_c", "_t")


def density(points: DataFrame, bounds: tuple[float, float, float, float], cell: float = 1.0) -> DataFrame:
    """Counts of all cells, empty ones too, floored from the south-west corner."""
    x0, y0, x1, y1 = bounds
    rows, cols = (max(1, -int(-(b - a) // cell)) for a, b in ((y0, y1), (x0, x1)))
    at = points.select(F.floor((F.col("y") - y0) / cell).cast("int").alias("r"), F.floor((F.col("x") - x0) / cell).cast("int").alias("c")).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
    return Grid(x0, y0, x1, y1, cell, rows, cols).dense(at).withColumn("n", F.coalesce("n", F.lit(0)))


def density_stats(cells: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))
    full = F.when(F.col("n") > 0, F.col("n"))
    return cells.agg(F.sum("n").alias("points"), F.count(full).alias("occupied"), F.avg((F.col("n") > 0).cast("double")).alias("occupancy"), q(F.col("n"), 0.5).alias("median_all"), q(F.col("n"), 0.9).alias("p90_all"), q(full, 0.5).alias("median_occupied"), F.max("n").alias("most"))


def surface_strata(points: DataFrame, band: float) -> DataFrame:
    """Adds on_surface, below_surface, above_surface, missing_surface from z and surface_z."""
    delta = f32(f32(F.col("z")) - F.col("surface_z"))
    on = yes(F.abs(delta) < f32(band))
    return points.withColumns({"on_surface": on, "below_surface": yes(~on & (delta <= f32(0.0))), "above_surface": yes(~on & (delta > f32(0.0))), "missing_surface": F.col("surface_z").isNull()})
