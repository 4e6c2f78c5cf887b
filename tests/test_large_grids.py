"""The branches for grids too large to be broadcast, and stretching by any ratio."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import grid as grids
from cellgrove.operators import raster, stencil
from cellgrove.operators.grid import Grid


def frame(spark, a):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)], "r int, c int, z double").repartition(3)


def stretched(a, n, m):
    """By the definition: half-pixel centres, clamped; empty corners weigh nothing, four empty ones give nothing."""
    out = np.full((n, m), np.nan)
    for i in range(n):
        for j in range(m):
            y, x = (i + 0.5) * (a.shape[0] / n) - 0.5, (j + 0.5) * (a.shape[1] / m) - 0.5
            t, any_value = 0.0, False
            for di in (0, 1):
                for dj in (0, 1):
                    r, c = min(max(int(np.floor(y)) + di, 0), a.shape[0] - 1), min(max(int(np.floor(x)) + dj, 0), a.shape[1] - 1)
                    if not np.isnan(a[r, c]):
                        wy, wx = y - np.floor(y), x - np.floor(x)
                        t, any_value = t + (wy if di else 1 - wy) * (wx if dj else 1 - wx) * a[r, c], True
            out[i, j] = t if any_value else np.nan
    return out


@pytest.mark.parametrize("shape, to", [((3, 4), (12, 16)), ((5, 7), (13, 9)), ((6, 5), (4, 3)), ((1, 1), (3, 5)), ((1, 6), (7, 1)), ((4, 4), (4, 4))])
def test_bilinear_by_the_definition(spark, shape, to):
    rng = np.random.default_rng(sum(shape))
    for share in (0, 0.4):
        a = np.round(rng.random(shape) * 50, 2)
        a[rng.random(shape) < share] = np.nan
        small, large = Grid(0, 0, shape[1], shape[0], 1.0, *shape), Grid(0, 0, to[1], to[0], 1.0, *to)
        got = np.full(to, np.nan)
        rows = stencil.bilinear(frame(spark, a), small, large).collect()
        for r in rows:
            got[r.r, r.c] = np.nan if r.dtm is None else r.dtm
        assert len(rows) == to[0] * to[1] and np.allclose(got, stretched(a, *to), atol=1e-4, equal_nan=True)


def test_resized_masks(spark):
    a = np.array([[-4.0, 4.0], [4.0, -4.0]])
    small, large = Grid(0, 0, 2, 2, 1.0, 2, 2), Grid(0, 0, 6, 6, 1.0, 6, 6)
    want = 1 / (1 + np.exp(-stretched(a, 6, 6)))
    for r in stencil.resize_mask(frame(spark, a).withColumnRenamed("z", "logit"), small, large).collect():
        assert r.probability == pytest.approx(want[r.r, r.c], abs=1e-6) and r.mask == (want[r.r, r.c] > 0.5)


def test_joins_without_broadcast_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    g = Grid(0, 0, 9, 7, 1.0, 7, 9)
    pts = spark.createDataFrame([(i, float(rng.random() * 9), float(rng.random() * 7), float(rng.random() * 5), int(rng.integers(0, 99))) for i in range(500)], "orig_index long, x double, y double, z double, red int")

    def tables():
        d = g.with_index(pts)
        top = raster.surface_max(d)
        near = raster.near_surface_means(d, top, g, ["red"])
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        sampled = stencil.grid_sample(g.dense(raster.lowest(pts, g)), g, pts.select("orig_index", "x", "y"), "z")
        return plan, [sorted(map(tuple, t.collect()), key=str) for t in (near, sampled, g.gather(d, top))]

    plan, small = tables()
    assert g.small() and "strategy=broadcast" in plan
    monkeypatch.setattr(grids, "BROADCAST_BYTES", 0)
    plan, large = tables()
    assert not g.small() and "strategy=broadcast" not in plan and small == large


def test_preview(spark):
    from cellgrove.operators import audit

    d = spark.range(101).select(F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.col("id").cast("double").alias("dtm"))
    got = {r.c: r.shade for r in audit.preview_stretch(d).collect()}
    assert got[0] == got[2] == 0.0 and got[98] == got[100] == 1.0 and got[50] == pytest.approx(0.5)
