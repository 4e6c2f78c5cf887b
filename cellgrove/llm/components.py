"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the neighbours go to the least of them, and on the row of the least the node itself does
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); the root is the component's smallest node.

    Each round roughly squares the reach of a root, until none changes anything; no group is ever gathered, only its
    minimum. The edges are settled before the first round: a round reads them four times, and with them would hold
    their whole plan four times.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    mark, seen = None, _state(now)
    while seen[0] and seen != mark:
        now, mark = settle(_small(_large(now))), seen
        seen = _state(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (u, v) between nodes: only the components they touch are put together anew."""
    at = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    over = links.join(side("u"), "u", "left").join(side("v"), "v", "left").select(at("u"), at("v"))
    new = components(over).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = new.join(roots.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return moved.unionByName(alone)
