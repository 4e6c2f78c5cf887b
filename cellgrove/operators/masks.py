"""Run-length masks, detections and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOX_FRACTION, TILE, TILE_STEP
from ..functions.scalar import box_area, f32
from . import intervals


def rle_encode(bits: Column) -> Column:
    """Run lengths of an array of 0/1 in row-major order, the first run background (of length 0 if the first is set)."""
    n, rest = F.size(bits), F.greatest(F.size(bits) - 1, F.lit(0))
    turned = F.zip_with(F.slice(bits, F.lit(2), rest), F.slice(bits, F.lit(1), rest), lambda b, a: b != a)
    turns = F.filter(F.transform(turned, lambda t, i: F.when(t, i + 1)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(0)), turns, F.array(n))
    runs = F.zip_with(F.slice(edges, F.lit(2), F.size(edges) - 1), F.slice(edges, F.lit(1), F.size(edges) - 1), lambda e, b: e - b)
    return F.when(F.get(bits, 0) == 1, F.concat(F.array(F.lit(0)), runs)).otherwise(runs)


def rle_decode(masks: DataFrame, counts: str = "counts", width: str = "w") -> DataFrame:
    """One row for each set pixel: the other columns, r, c. Operators on whole masks take intervals instead."""
    return intervals.pixels(intervals.of_runs(masks, counts, width))


def drop_large_boxes(detections: DataFrame, fraction: float = BOX_FRACTION) -> DataFrame:
    """Without detections whose box covers more than the fraction of the image (h, w)."""
    return detections.where(~(box_area(F.col("bbox")) > F.lit(fraction) * F.col("h") * F.col("w")))


def union_masks(detections: DataFrame, by: list[str]) -> DataFrame:
    """The greatest score of each pixel: by..., r, c, score; overlaps are settled among intervals."""
    cut = intervals.of_runs(detections.withColumn("score", f32(F.col("score"))))
    return intervals.pixels(intervals.union(cut, by))


def stitch(tiles: DataFrame) -> DataFrame:
    """Tile pixels (row0, col0, r, c, class, score) on the whole grid; where tiles overlap the greater score counts."""
    return tiles.groupBy((F.col("row0") + F.col("r")).alias("r"), (F.col("col0") + F.col("c")).alias("c"), "class").agg(F.max("score").alias("score"))


def pivot_confidence(pixels: DataFrame, names: list[str]) -> DataFrame:
    return pixels.groupBy("r", "c").agg(*[F.coalesce(F.max(F.when(F.col("class") == n, F.col("score"))), f32(0.0)).alias(n) for n in names])


def coverage(pixels: DataFrame, cells: int, floor: float = 0.1) -> DataFrame:
    """By class: the share of all cells with a score over the floor, and the greatest score."""
    return pixels.groupBy("class").agg((F.count_if(F.col("score") > f32(floor)) / F.lit(float(cells))).alias("coverage"), F.max("score").alias("top"))


def mask_boxes(pixels: DataFrame, masks: DataFrame, by: list[str]) -> DataFrame:
    """The box of each mask: least and greatest pixel + 1; zeros for an empty one."""
    box = pixels.groupBy(*by).agg(F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") + 1).alias("x1"), (F.max("r") + 1).alias("y1"))
    return masks.select(*by).join(box, by, "left").fillna(0, ["x0", "y0", "x1", "y1"])


def tile_offsets(total: Column, tile: int = TILE, step: int = TILE_STEP) -> Column:
    """0, step, ... while a whole tile fits, then the last tile that does, if it is another."""
    last = F.greatest(total - tile, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def tiles(spark, rows: int, cols: int, tile: int = TILE, step: int = TILE_STEP) -> DataFrame:
    one = spark.range(1)
    return one.select(F.explode(tile_offsets(F.lit(rows), tile, step)).alias("row0")).crossJoin(one.select(F.explode(tile_offsets(F.lit(cols), tile, step)).alias("col0")))


def per_prompt(detections: DataFrame) -> DataFrame:
    return detections.groupBy("tile", "prompt").agg(F.count(F.lit(1)).alias("detections"))


def merge_responses(old: Column, new: Column) -> Column:
    """Cached detections by prompt, the new ones winning."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def fitting(detections: DataFrame) -> DataFrame:
    """Without detections whose mask has another size (h, w) than their tile (tile_h, tile_w), or runs that don't fill it."""
    filled = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("h") * F.col("w")
    return detections.where((F.col("h") == F.col("tile_h")) & (F.col("w") == F.col("tile_w")) & filled)


def resized(detections: DataFrame, by: list[str]) -> DataFrame:
    """Detections with the runs, h and w of their image (tile_h, tile_w): masks of another size are stretched to it.

    by: columns that tell detections apart. Masks whose runs don't fill their own size go.
    """
    size = F.col("h").cast("long") * F.col("w")
    whole = detections.where(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) == size)
    same = (F.col("h") == F.col("tile_h")) & (F.col("w") == F.col("tile_w"))
    other = whole.where(~same)
    cut = intervals.of_runs(other.select(*by, "counts", "h", "w", "tile_h", "tile_w"))
    cut = intervals.stretched(cut, *map(F.col, ("h", "w", "tile_h", "tile_w")))
    image = other.withColumns({"h": F.col("tile_h"), "w": F.col("tile_w")}).drop("counts")
    runs = intervals.runs_of(cut, image, by).select(*by, "counts")
    return whole.where(same).unionByName(image.join(runs, by).select(*whole.columns))
