"""Annotation rounds: preparing tiles, blind packages, and putting labels back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_TILE_INDEX
from ..functions.scalar import exg_audit
from ..operators import audit, matching, points, raster, stencil
from ..operators.grid import Grid

#: What an annotator may see.
VISIBLE = ("x", "y", "z", "red", "green", "blue")


def prepare(tile: DataFrame, key: str = "orig_index") -> tuple[DataFrame, dict]:
    """The tile with tile_index (its dense position by id) instead of the id, and what the manifest records.

    Indices must be exact as 32-bit floats, which is what annotation tools keep.
    """
    points.require_unique(tile, key)
    d = points.ordinal(tile, key, "tile_index")
    n = tile.count()
    if n >= MAX_TILE_INDEX:
        raise ValueError(f"{n} points are too many for one tile")
    rows, digest = points.digest(d.select("tile_index", key, "x", "y", "z"), ["tile_index", key, "x", "y", "z"]).first()
    return d, {"points": rows, "digest": str(digest)}


def restore(prepared: DataFrame, labelled: DataFrame, record: dict, key: str = "orig_index") -> DataFrame:
    """Labels on the original ids; the prepared tile must be the recorded one."""
    rows, digest = points.digest(prepared.select("tile_index", key, "x", "y", "z"), ["tile_index", key, "x", "y", "z"]).first()
    if (rows, str(digest)) != (record["points"], record["digest"]):
        raise matching.AlignmentError("the prepared tile has changed")
    return matching.restore(prepared, labelled)


def strata(cloud: DataFrame, grid: Grid) -> DataFrame:
    """Adds exg (audit), boundary and stratum to points with hag and colour."""
    d = grid.with_index(cloud.withColumn("exg", exg_audit()))
    cells = d.groupBy("r", "c").agg(F.max("z").alias("z"), F.avg("exg").alias("exg"))
    flags = stencil.ranges(cells, grid).select("r", "c", stencil.boundary_flag().alias("boundary"))
    d = grid.gather(d, flags)
    return d.withColumn("stratum", audit.stratum_code(F.col("hag"), F.col("exg"), F.col("boundary")))


def blind_package(cloud: DataFrame, grid: Grid, reviewed: str = "reviewed", most: int = 50, seed: int = 0, key: str = "orig_index") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(package, private map, strata): the package has dense local ids, what an annotator may see and audit_target, and
    no label, prediction or other field; the private map (local_id, key, stratum) stays behind."""
    d = strata(cloud, grid)
    chosen, counts = points.stratified(d.where(reviewed), "stratum", most, seed, key)
    d = d.join(chosen.select(key, F.lit(1).alias("audit_target")), key, "left").withColumn("audit_target", F.coalesce("audit_target", F.lit(0)))
    d = points.ordinal(d.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), "_h", "local_id")
    return d.select("local_id", *VISIBLE, "audit_target"), d.select("local_id", key, "stratum"), counts


def quality_report(cloud: DataFrame, bounds: tuple[float, float, float, float], channels: tuple[str, ...] = ("red", "green", "blue")) -> dict[str, DataFrame]:
    """The tables of the data-quality report for a rectangle."""
    d = points.crop(cloud, bounds, closed=False)
    h = audit.value_histogram(d, list(channels))
    return {"density": raster.density_stats(raster.density(d, bounds)), "channels": audit.histogram_quantiles(h), "patterns": audit.rgb_patterns(h), "endpoints": audit.rgb_endpoints(d), "heights": audit.height_stats(d), "height_quantiles": audit.quantiles(d, "hag")}
