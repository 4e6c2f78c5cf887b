"""Joins of boxes (arrays x0, y0, x1, y1) that overlap, by a hierarchy of grids instead of all pairs.

A box belongs to the level whose cells are as large as its longer side, so it reaches into four cells there at most. It also
looks into the coarser levels that are in use, where larger boxes live. A pair meets at the level of its larger box and
is reported in one cell only, that of the upper left corner of what both cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import box_intersection

FINEST = -20  # the least level, of cells with sides of 2 ** -20; smaller boxes live there too


def _level(b: Column) -> Column:
    side = F.greatest(F.get(b, 2) - F.get(b, 0), F.get(b, 3) - F.get(b, 1))
    return F.greatest(F.ceil(F.log2(side)), F.lit(FINEST)).cast("int")


def _solid(b: Column) -> Column:
    finite = [F.abs(F.get(b, k)) < float("inf") for k in range(4)]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3)), F.lit(False))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], keys: tuple[str, str], boxes: tuple[str, str] = ("bbox", "bbox")) -> DataFrame:
    """by..., k1, k2, overlap (area > 0) of every pair of a box of a and one of b with equal `by`.

    Touching boxes don't overlap; boxes that are null, reversed, flat or not finite overlap nothing. Keys needn't be
    unique: rows meet, not keys. What is collected are the levels in use, a few dozen at most. Cells are joined by
    equality, so crowded ones can be split by Spark like any skewed key. Both sides are always shuffled and sorted:
    Spark's estimates leave out that a box becomes several cells, so it would broadcast whole sides of any size.
    """
    sides = []
    for d, key, box in ((a, keys[0], boxes[0]), (b, keys[1], boxes[1])):
        c = F.col(box).cast("array<double>")
        sides.append(d.where(_solid(c)).select(*by, F.col(key).alias("k"), c.alias("x"), _level(c).alias("own")))
    levels = sorted({r[0] for r in sides[0].select("own").union(sides[1].select("own")).distinct().collect()})
    if not levels:
        levels = [0]
    size = F.pow(F.lit(2.0), F.col("level"))

    def cells(d: DataFrame, k: str, x: str, own: bool) -> DataFrame:
        """The cells that hold some area of each box, at its own level or at the coarser ones."""
        there = F.array(*map(F.lit, levels))
        d = d.withColumn("level", F.col("own") if own else F.explode(F.filter(there, lambda v: v > F.col("own"))))
        for at, low, high in (("i", 0, 2), ("j", 1, 3)):
            d = d.withColumn(at, F.explode(F.sequence(F.floor(F.get("x", low) / size), F.ceil(F.get("x", high) / size) - 1)))
        return d.select(*by, "level", "i", "j", F.col("k").alias(k), F.col("x").alias(x))

    left, right = ([cells(d, k, x, own) for own in (True, False)] for d, k, x in ((sides[0], "k1", "x1"), (sides[1], "k2", "x2")))
    on = [*by, "level", "i", "j"]
    met = left[0].join(right[0].unionByName(right[1]).hint("merge"), on).unionByName(left[1].join(right[0].hint("merge"), on))
    corner = lambda k: F.floor(F.greatest(F.get("x1", k), F.get("x2", k)) / size)
    once = met.where((corner(0) == F.col("i")) & (corner(1) == F.col("j")))
    return once.withColumn("overlap", box_intersection(F.col("x1"), F.col("x2"))).where("overlap > 0").select(*by, "k1", "k2", "overlap")
