"""Stages with prerequisites, and the production pipeline from points to scored labels."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES, DECIMATE_CELL, Fusion, Transfer
from ..functions.scalar import exg, f32, las_code
from ..operators import cloth, fusion, matching, metrics, raster, stencil, transfer
from ..operators.grid import Grid


class StageError(RuntimeError):
    pass


@dataclass
class Stages:
    """Named stages; each lists the paths that must exist before it runs, and the first failure ends the run."""

    steps: dict[str, tuple[Callable[[], None], tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, run: Callable[[], None], needs: tuple[str, ...] = ()) -> Stages:
        self.steps[name] = (run, needs)
        return self

    def plan(self, chosen: str) -> list[str]:
        if chosen != "all" and chosen not in self.steps:
            raise StageError(f"unknown stage {chosen}; there are {', '.join(self.steps)}")
        return list(self.steps) if chosen == "all" else [chosen]

    def run(self, chosen: str = "all") -> list[str]:
        done = []
        for name in self.plan(chosen):
            run, needs = self.steps[name]
            if absent := [p for p in needs if not os.path.exists(p)]:
                raise StageError(f"{name} needs {', '.join(absent)}")
            run()
            done.append(name)
        return done


def features(points: DataFrame) -> DataFrame:
    """Adds exg and FLOAT intensity."""
    d = points.withColumn("exg", exg())
    return d.withColumn("intensity", f32(F.col("intensity"))) if "intensity" in points.columns else d


def terrain(points: DataFrame, grid: Grid, filter_ground: bool = True) -> DataFrame:
    """The terrain (r, c, dtm) of the fine grid: lowest point of each coarse cell, without low outliers, ground by cloth
    simulation, gaps filled, stretched."""
    small = grid.coarse(DECIMATE_CELL)
    r, c = small.index()
    lowest = points.withColumns({"r": r, "c": c}).groupBy("r", "c").agg(F.min_by(F.struct("x", "y", "z"), "z").alias("p"))
    cells = lowest.select("r", "c", F.col("p.z").alias("z"))
    kept = stencil.low_outliers(cells, small).where("not outlier").select("r", "c")
    decimated = lowest.join(kept, ["r", "c"]).select("p.x", "p.y", "p.z")
    floor = cloth.ground(decimated) if filter_ground else decimated
    filled = stencil.fill_gaps(small.dense(raster.lowest(floor, small)), small)
    return stencil.bilinear(filled, small, grid)


def rule_cells(stats: DataFrame) -> DataFrame:
    """Stat cells with rule proposals as the confidences of the classes: the default where no detector is given."""
    return stats.withColumns({n: fusion.proposals(fusion.baseline())[n] for _, n, *_ in CLASSES})


def label(points: DataFrame, grid: Grid, confidence: DataFrame | None = None, fuse: Fusion | None = None, options: Transfer | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d, filter_ground: bool = True) -> DataFrame:
    """Points with label, score, source, route and LAS code: terrain, statistics, fusion, transfer.

    confidence: r, c and a FLOAT column per class, else rule proposals. keep: persists or writes what is read twice.
    """
    d = features(points)
    d = keep(grid.with_index(raster.height_above(d, grid, terrain(points, grid, filter_ground))))
    stats = keep(raster.stat_grid(d, grid, ["red", "green", "blue", "exg", "hag"]).withColumns({"exg": f32(F.col("exg")), "hag": f32(F.col("hag"))}))
    cells = rule_cells(stats) if confidence is None else stats.join(confidence, ["r", "c"], "left").fillna(0.0, [n for _, n, *_ in CLASSES])
    labels = fusion.fuse(cells, grid, fuse)
    view = labels.join(stats.select("r", "c", "surface_z"), ["r", "c"])
    return transfer.transfer(grid.gather(d, view), options=options).withColumn("las_code", las_code(F.col("internal_class_id")))


def evaluate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """code, tp, denominator, iou of the matched points that the truth reviews."""
    return metrics.iou(metrics.confusion(matching.match(truth, predicted).where(matching.reviewed())))


def evaluate_all(truths: dict[str, DataFrame | None], predictions: dict[str, DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """The scores of all tiles that have a truth, and the names of those left out."""
    out, skipped = None, []
    for name, p in predictions.items():
        if truths.get(name) is None:
            skipped.append(name)
            continue
        one = evaluate(truths[name], p).withColumn("tile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out, skipped


def session(name: str = "cellgrove", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
