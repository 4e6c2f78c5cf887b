"""Distance field and inpainting against a plain version, cell by cell, of the same published weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import inpainting
from cellgrove.operators.grid import Grid


def raster(spark, a):
    """A frame of an array (rows, cols, channels) with NaN for voids."""
    rows = [(r, c, *(None if np.isnan(v) else float(v) for v in a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"v{i} double" for i in range(a.shape[2]))).repartition(3), Grid(0, 0, a.shape[1], a.shape[0], 1.0, *a.shape[:2])


def gaps(seed, shape=(40, 37), share=0.5):
    rng = np.random.default_rng(seed)
    a = np.round(rng.random((*shape, 2)) * 200)
    void = rng.random(shape) < share
    void[8:22, 5:19] = True
    void[10, 9] = False
    a[void] = np.nan
    return a


def distance(a):
    known = np.argwhere(~np.isnan(a).any(2))
    return np.array([[((known - (r, c)) ** 2).sum(1).min() for c in range(a.shape[1])] for r in range(a.shape[0])])


def plain(a):
    """Cells by ring, each from the original cells and the earlier rings within the radius."""
    d2 = distance(a)
    d = np.sqrt(d2)
    ring = np.ceil(d)
    h, w, n = a.shape
    out = a.copy()

    def slope(get, known, r, c, axis):
        step = (1, 0) if axis == 0 else (0, 1)
        diffs = []
        for s in (1, -1):
            y, x = r + s * step[0], c + s * step[1]
            if 0 <= y < h and 0 <= x < w and known(y, x):
                diffs.append(s * (get(y, x) - get(r, c)))
        return sum(diffs) / len(diffs) if diffs else 0.0

    for k in range(1, int(ring.max()) + 1):
        was = out.copy()
        for r, c in np.argwhere(ring == k):
            normal = [slope(lambda y, x: d[y, x], lambda y, x: True, r, c, i) for i in (0, 1)]
            top, bottom = np.zeros(n), 0.0
            for y in range(r - 3, r + 4):
                for x in range(c - 3, c + 4):
                    if 0 <= y < h and 0 <= x < w and ring[y, x] < k and 0 < (r - y) ** 2 + (c - x) ** 2 <= 9:
                        length = math.hypot(r - y, c - x)
                        toward = abs((r - y) * normal[0] + (c - x) * normal[1]) / length
                        weight = max(toward, 1e-6) / length**2 / (1 + abs(d[y, x] - d[r, c]))
                        g = [slope(lambda p, q: was[p, q], lambda p, q: ring[p, q] < k, y, x, i) for i in (0, 1)]
                        top += weight * (was[y, x] + g[0] * (r - y) + g[1] * (c - x))
                        bottom += weight
            out[r, c] = top / bottom
    return out


def collected(d, shape):
    a = np.full(shape, np.nan)
    for row in d.collect():
        a[row.r, row.c] = [np.nan if row[f"v{i}"] is None else row[f"v{i}"] for i in range(shape[2])]
    return a


def test_distances(spark):
    a = gaps(1, share=0.9)
    d, g = raster(spark, a)
    got = {(r.r, r.c): r.d2 for r in inpainting.distances(d, g, "v0").collect()}
    want = distance(a)
    assert got == {(r, c): int(want[r, c]) for r in range(a.shape[0]) for c in range(a.shape[1])}


@pytest.mark.parametrize("block, rings", [(512, 64), (12, 64), (12, 2)])
def test_inpainting_equals_the_plain_version(spark, monkeypatch, block, rings):
    """As one block, as blocks with halos, and in several rounds."""
    monkeypatch.setattr(inpainting, "BLOCK", block)
    monkeypatch.setattr(inpainting, "RINGS", rings)
    a = gaps(2)
    d, g = raster(spark, a)
    got = collected(inpainting.inpaint(d.withColumn("note", F.lit("kept")), g, "v0", "v1"), a.shape)
    assert np.allclose(got, plain(a), atol=1e-9) and (got[~np.isnan(a)] == a[~np.isnan(a)]).all()


def test_slopes_go_on_over_a_void(spark):
    """A plane is continued exactly."""
    r, c = np.mgrid[:20, :20]
    a = (3.0 * r + 2.0 * c)[:, :, None].copy()
    want = a.copy()
    a[6:14, 7:12] = np.nan
    d, g = raster(spark, a)
    assert np.allclose(collected(inpainting.inpaint(d, g, "v0"), a.shape), want)


def test_inpainting_edges(spark):
    a = np.full((4, 6, 1), np.nan)
    d, g = raster(spark, a)
    assert np.isnan(collected(inpainting.inpaint(d, g, "v0"), a.shape)).all()  # nothing to fill from
    a[:] = 5.0
    d, g = raster(spark, a)
    assert (collected(inpainting.inpaint(d, g, "v0"), a.shape) == 5.0).all()
    part = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, 3.0, 4.0)], "r int, c int, v0 double, v1 double")  # a void in one channel
    assert {(r.c, r.v0, r.v1) for r in inpainting.inpaint(part, Grid(0, 0, 2, 1, 1.0, 1, 2), "v0", "v1").collect()} == {(0, 3.0, 4.0), (1, 3.0, 4.0)}


def test_colours_and_black_voids(spark):
    g = Grid(0, 0, 5, 1, 1.0, 1, 5)
    d = g.cells(spark).withColumns({c: F.when(F.col("c") != 2, 100 + F.col("c")) for c in ("red8", "green8", "blue8")})
    assert {r.red8 for r in inpainting.inpaint_rgb(d, g).where("c = 2").collect()} == {102}
    dark = d.withColumns({c: F.when(F.col(c).isNotNull(), 0) for c in ("red8", "green8", "blue8")})
    with pytest.raises(Exception, match="stayed black"):
        inpainting.inpaint_rgb(dark, g).collect()
