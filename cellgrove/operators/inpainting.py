"""Void inpainting: an exact distance field, and voids filled in order of distance with Telea's weights.

A void cell's distance is that to the nearest filled cell; a ring is the whole part of the distance, rounded up. Cells
of a ring are filled together from original cells and earlier rings within RADIUS, so a cell depends on cells at most
REACH away a ring and blocks with a halo give what the whole raster would.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import Grid

RADIUS = 3
#: Cells that a ring's values can depend on: the radius, and one more for the slope there.
REACH = RADIUS + 1
#: Rings filled by one job, and the side of a block without its halo.
RINGS, BLOCK = 64, 512
_BAND = 16


def distances(cells: DataFrame, grid: Grid, value: str) -> DataFrame:
    """r, c, d2 of all cells: the squared distance to the nearest cell with a value, null if there is none.

    Separable: along each row the nearest filled column, then along the columns the lower envelope of the parabolas
    that these distances stand for. A row, and _BAND columns, are the most that one task holds.
    """
    w = Window.partitionBy("r").orderBy("c")
    filled = F.when(F.col(value).isNotNull(), F.col("c"))
    before = F.last(filled, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(filled, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    along = cells.select("r", "c", F.least(F.col("c") - before, after - F.col("c")).alias("g"))

    def envelope(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        best = np.full((grid.rows, _BAND), np.inf)
        best[r, c % _BAND] = table.column("g").to_numpy().astype(float) ** 2
        best[np.isnan(best)] = np.inf
        g, k = best.copy(), 1
        while k < grid.rows and k * k < best.max():  # what lies k rows away is at least k * k away
            np.minimum(best[k:], g[:-k] + k * k, out=best[k:])
            np.minimum(best[:-k], g[k:] + k * k, out=best[:-k])
            k += 1
        d = best[r, c % _BAND]
        return pa.table({"r": table.column("r"), "c": table.column("c"), "d2": pa.array(np.where(np.isinf(d), 0, d).astype(np.int64), mask=np.isinf(d))})

    return along.groupBy(F.floor(F.col("c") / _BAND).alias("_band")).applyInArrow(lambda t: envelope(t), "r int, c int, d2 long")


def _slope(a: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences along rows and columns; one-sided where one neighbour is unknown, 0 where both are."""
    out = []
    for axis in (0, 1):
        pad = [(1, 1) if i == axis else (0, 0) for i in range(a.ndim)]
        v, k = np.pad(np.where(known.reshape(known.shape + (1,) * (a.ndim - 2)), a, 0), pad), np.pad(known, pad[:2])
        part = lambda x, i: x[i : i + a.shape[0]] if axis == 0 else x[:, i : i + a.shape[1]]  # noqa: B023, E731
        ahead, behind = part(k, 2), part(k, 0)
        up = np.where((ahead & known).reshape(ahead.shape + (1,) * (a.ndim - 2)), part(v, 2) - part(v, 1), 0)
        down = np.where((behind & known).reshape(ahead.shape + (1,) * (a.ndim - 2)), part(v, 1) - part(v, 0), 0)
        sides = (ahead & known).astype(float) + (behind & known)
        out.append((up + down) / np.maximum(sides, 1).reshape(sides.shape + (1,) * (a.ndim - 2)))
    return out[0], out[1]


def fill(values: np.ndarray, dist: np.ndarray, inside: np.ndarray, first: int, last: int) -> np.ndarray:
    """values (rows, cols, channels) with the rings first..last filled; dist: distances, inside: cells of the raster."""
    values, ring = values.copy(), np.where(inside, np.ceil(dist), np.inf)
    ty, tx = _slope(dist[:, :, None], inside)
    ty, tx = ty[:, :, 0], tx[:, :, 0]
    steps = [(i, j) for i in range(-RADIUS, RADIUS + 1) for j in range(-RADIUS, RADIUS + 1) if 0 < i * i + j * j <= RADIUS * RADIUS]
    for k in range(first, last + 1):
        r, c = np.nonzero(ring == k)
        if not len(r):
            continue
        gy, gx = _slope(values, ring < k)
        total, weights, base = np.zeros((len(r), values.shape[2])), np.zeros(len(r)), np.zeros((len(r), values.shape[2]))
        for i, j in steps:
            y, x = r + i, c + j
            ok = (y >= 0) & (y < ring.shape[0]) & (x >= 0) & (x < ring.shape[1])
            y, x = np.where(ok, y, 0), np.where(ok, x, 0)
            ok &= ring[y, x] < k
            along = np.abs(-i * ty[r, c] - j * tx[r, c]) / np.hypot(i, j)  # towards the front
            w = np.where(ok, np.maximum(along, 1e-6) / (i * i + j * j) / (1 + np.abs(dist[y, x] - dist[r, c])), 0.0)
            base = np.where((ok & (weights == 0))[:, None], values[y, x], base)  # sums of differences keep a flat area flat
            total += w[:, None] * np.where(ok[:, None], values[y, x] - i * gy[y, x] - j * gx[y, x] - base, 0)
            weights += w
        values[r, c] = base + total / weights[:, None]
    return values


def _void(values) -> Column:
    return reduce(or_, [F.col(v).isNull() for v in values])


def inpaint(cells: DataFrame, grid: Grid, *values: str) -> DataFrame:
    """The cells with their void values (double) filled; a cell is void where any of the values is null.

    The deepest void tells how wide a halo is. RINGS rings take one job, whatever the number of cells, so only voids
    deeper than that take another; those cut the lineage where a checkpoint folder is set. A raster without any whole
    cell stays as it is.
    """
    d = cells.withColumns({v: F.col(v).cast("double") for v in values})
    void = _void(values)
    field = distances(d.select("r", "c", F.when(~void, 1).alias("_v")), grid, "_v")
    if kept := d.sparkSession.sparkContext.getCheckpointDir():
        field = field.checkpoint()
    deepest = field.agg(F.ceil(F.sqrt(F.max("d2")))).first()[0]
    done = 0
    while deepest and done < deepest:
        if done and kept:
            d = d.checkpoint()
        d, done = _round(d, field, grid, list(values), done + 1, min(deepest, done + RINGS)), done + RINGS
    return d


def _round(d: DataFrame, field: DataFrame, grid: Grid, values: list[str], first: int, last: int) -> DataFrame:
    halo = REACH * (last - first + 1) + 1
    block = max(BLOCK, halo)
    ring = F.ceil(F.sqrt("d2")).cast("int")
    both = d.select("r", "c", *values).join(field, ["r", "c"])
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + o) / block).cast("int") for o in (-halo, 0, halo)]))
    dealt = both.withColumn("_br", F.explode(near("r"))).withColumn("_bc", F.explode(near("c")))
    wanted = field.where(ring.between(first, last)).select(*[F.floor(F.col(c) / block).cast("int").alias(b) for c, b in (("r", "_br"), ("c", "_bc"))]).distinct()

    def run(key, t):
        top, left = (k.as_py() * block - halo for k in key)
        side = block + 2 * halo
        r, c = t.column("r").to_numpy() - top, t.column("c").to_numpy() - left
        inside, dist, a = np.zeros((side, side), bool), np.zeros((side, side)), np.zeros((side, side, len(values)))
        inside[r, c], dist[r, c] = True, np.sqrt(t.column("d2").to_numpy())
        for i, v in enumerate(values):
            a[r, c, i] = np.nan_to_num(t.column(v).to_numpy())
        a = fill(a, dist, inside, first, last)
        at = dist[r, c]
        own = (r >= halo) & (r < halo + block) & (c >= halo) & (c < halo + block) & (np.ceil(at) >= first) & (np.ceil(at) <= last)
        r, c = r[own], c[own]
        return pa.table([pa.array((r + top).astype(np.int32)), pa.array((c + left).astype(np.int32)), *(pa.array(a[r, c, i]) for i in range(len(values)))], names=["r", "c", *(f"_{v}" for v in values)])

    filled = dealt.join(wanted, ["_br", "_bc"], "left_semi").groupBy("_br", "_bc").applyInArrow(run, "r int, c int, " + ", ".join(f"`_{v}` double" for v in values))
    out = d.join(filled, ["r", "c"], "left")
    return out.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*[f"_{v}" for v in values])


def inpaint_rgb(cells: DataFrame, grid: Grid, channels: tuple[str, str, str] = ("red8", "green8", "blue8")) -> DataFrame:
    """8-bit colours with their voids filled, rounded and clipped; a void cell that comes out black is an error."""
    d = inpaint(cells.withColumn("_void", _void(channels)), grid, *channels)
    d = d.withColumns({v: F.greatest(F.least(F.round(v), F.lit(255)), F.lit(0)).cast("int") for v in channels})
    black = F.col("_void") & (sum((F.col(v) for v in channels), F.lit(0)) == 0)
    return d.withColumn(channels[0], F.when(black, F.raise_error(F.lit("a void cell stayed black"))).otherwise(F.col(channels[0]))).drop("_void")
