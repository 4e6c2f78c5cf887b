"""Ground filter by cloth simulation (after Zhang et al. 2016), on decimated points.

The cloth is one connected system, so it is solved in one group; what bounds it is the decimation to one point per
cell, which is checked. Larger sites are solved by blocks with a margin of cells that both neighbours see.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLOTH_RESOLUTION

#: Cells of a block's side, the margin on each side, and the most points of a group.
BLOCK, MARGIN, MOST = 256, 32, 400_000


def simulate(xyz: np.ndarray, resolution: float = CLOTH_RESOLUTION, threshold: float = 0.5, iterations: int = 500, rigidness: int = 3, step: float = 0.65) -> np.ndarray:
    """True for the points within `threshold` of a cloth that fell on the inverted cloud."""
    if not len(xyz):
        return np.zeros(0, bool)
    x, y, z = xyz[:, 0], xyz[:, 1], -xyz[:, 2]
    c = ((x - x.min()) / resolution).round().astype(int) + 2
    r = ((y - y.min()) / resolution).round().astype(int) + 2
    shape = (r.max() + 3, c.max() + 3)
    floor = np.full(shape, -np.inf)
    np.maximum.at(floor, (r, c), z)
    known = np.isfinite(floor)
    while not known.all():  # particles over no point stop at their neighbours' mean
        pad, has = np.pad(np.where(known, floor, 0.0), 1), np.pad(known, 1).astype(float)
        around = lambda a: a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:]
        n = around(has)
        new = ~known & (n > 0)
        floor[new] = (around(pad) / np.maximum(n, 1))[new]
        known |= new
    height = np.full(shape, z.max() + 0.05)
    before = height.copy()
    free = np.ones(shape, bool)
    fall, keep = -0.2 * step * step, 1 - 0.01
    share = 1 - 0.5**rigidness
    for _ in range(iterations):
        moved = np.where(free, height + (height - before) * keep + fall, height)
        before, height = height, moved
        for axis in (0, 1):
            for odd in (0, 1):
                a = np.moveaxis(height, axis, 0)
                f = np.moveaxis(free, axis, 0)
                n = (len(a) - odd) // 2 * 2
                p, q = a[odd : odd + n : 2], a[odd + 1 : odd + n : 2]
                fp, fq = f[odd : odd + n : 2], f[odd + 1 : odd + n : 2]
                gap = (q - p) * share
                both = fp & fq
                up, down = np.where(both, gap / 2, np.where(fp, gap, 0.0)), np.where(both, gap / 2, np.where(fq, gap, 0.0))
                p += up
                q -= down
        hit = free & (height <= floor)
        height[hit] = floor[hit]
        free &= ~hit
        if not free.any() or np.abs(height - before)[free].max() < 0.005:
            break
    u, v = (x - x.min()) / resolution + 2, (y - y.min()) / resolution + 2
    i, j = np.floor(v).astype(int), np.floor(u).astype(int)
    a, b = v - i, u - j
    at = height[i, j] * (1 - a) * (1 - b) + height[i, j + 1] * (1 - a) * b + height[i + 1, j] * a * (1 - b) + height[i + 1, j + 1] * a * b
    return np.abs(at - z) <= threshold


def ground(points: DataFrame, resolution: float = CLOTH_RESOLUTION, **options) -> DataFrame:
    """The points (x, y, z; decimated) that the cloth rests on."""
    size = BLOCK * resolution
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    near = lambda c: F.sequence(F.floor((F.col(c) - MARGIN * resolution) / size).cast("int"), F.floor((F.col(c) + MARGIN * resolution) / size).cast("int"))
    d = points.select("x", "y", "z", at("x").alias("ox"), at("y").alias("oy"), F.explode(near("x")).alias("bx"), near("y").alias("_y")).withColumn("by", F.explode("_y")).drop("_y")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST:
            raise ValueError("decimate the points first")
        pdf = pdf.sort_values(["x", "y", "z"])
        kept = pdf[simulate(pdf[["x", "y", "z"]].to_numpy(), resolution, **options)]
        return kept[(kept.ox == kept.bx) & (kept.oy == kept.by)][["x", "y", "z"]]

    return d.groupBy("bx", "by").applyInPandas(solve, "x double, y double, z double")
