import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import cloth, inpainting, raster, stencil
from cellgrove.operators.grid import Grid


def frame(spark, a, name="z"):
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"r int, c int, {name} double")


def array(df, shape, name):
    out = np.full(shape, np.nan)
    for r, c, v in df.select("r", "c", name).collect():
        out[r, c] = np.nan if v is None else v
    return out


def grid(a):
    return Grid(0, 0, a.shape[1], a.shape[0], 1.0, *a.shape)


def windows(a, size):
    lo, hi = size // 2, size - size // 2 - 1
    p = np.pad(a, ((lo, hi), (lo, hi)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size))


@pytest.fixture(scope="module")
def holes():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 160, (11, 14)) / 16.0
    a[rng.random(a.shape) < 0.35] = np.nan
    return a


@pytest.mark.parametrize("size", [4, 5, 17, 65])
def test_box_mean(spark, holes, size):
    a = np.nan_to_num(holes)
    got = array(stencil.box_mean(frame(spark, a), grid(a), size, "z"), a.shape, "mean")
    assert np.allclose(got, windows(a, size).mean((2, 3)), atol=1e-9)


def test_fill_gaps_uses_original_cells(spark, holes):
    v, m = np.nan_to_num(holes), (~np.isnan(holes)).astype(float)
    want = holes.copy()
    for size in (5, 17, 65):
        s, n = windows(v, size).sum((2, 3)), windows(m, size).sum((2, 3))
        fill = np.where(n > 0.5, s / np.maximum(n, 1), np.nan)
        want = np.where(np.isnan(want), fill, want)
    got = array(stencil.fill_gaps(frame(spark, holes), grid(holes)), holes.shape, "z")
    assert np.allclose(got, want)


def test_low_outliers(spark, holes):
    got = {(r.r, r.c): (r.median, r.outlier) for r in stencil.low_outliers(frame(spark, holes).where("z is not null"), grid(holes), 3.0).collect()}
    b = np.where(np.isnan(holes), np.inf, holes)
    for (r, c), z in np.ndenumerate(holes):
        if not np.isnan(z):
            m = np.sort(b[max(r - 2, 0) : r + 3, max(c - 2, 0) : c + 3].ravel())
            med = (m[(len(m) - 1) // 2] + m[len(m) // 2]) / 2
            assert got[r, c][1] == (np.isfinite(med) and z < med - 3)
            assert (got[r, c][0] or np.inf) == med or got[r, c][0] == med


@pytest.mark.parametrize("size", [1, 3, 5, 9])
def test_majority(spark, size):
    rng = np.random.default_rng(size)
    a = rng.integers(-1, 4, (13, 17))
    d = frame(spark, a.astype(float), "v").withColumn("label", F.col("v").cast("int"))
    got = array(stencil.majority(d, grid(a), size), a.shape, "label")
    w = windows(a, size).reshape(*a.shape, -1)
    want = np.array([[np.argmax(np.bincount(x + 1, minlength=9)) - 1 for x in row] for row in w])
    assert (got == want).all()
    with pytest.raises(ValueError):
        stencil.majority(d, grid(a), 4)


def test_bilinear_keeps_constants_and_ramps(spark):
    a = np.full((3, 4), 2.5)
    g, big = grid(a), Grid(0, 0, 4, 3, 0.25, 12, 16)
    assert (array(stencil.bilinear(frame(spark, a), g, big), (12, 16), "dtm") == 2.5).all()
    ramp = np.tile(np.arange(4.0), (3, 1))
    got = array(stencil.bilinear(frame(spark, ramp), g, big), (12, 16), "dtm")
    assert np.allclose(got[0], np.clip((np.arange(16) + 0.5) / 4 - 0.5, 0, 3))
    assert set(stencil.resize_mask(frame(spark, a - 5, "logit"), g, big).select("mask").distinct().collect()[0]) == {False}


def test_ranges_count_borders_as_empty(spark):
    a = np.zeros((3, 3))
    a[1, 1] = 5
    d = frame(spark, a).withColumn("exg", F.lit(0.0))
    got = {(r.r, r.c): (r.z_range, r.empty_neighbour) for r in stencil.ranges(d, grid(a)).collect()}
    assert got[1, 1] == (5.0, False) and got[0, 0] == (5.0, True)


def test_inpaint(spark):
    a = np.full((4, 4), np.nan)
    a[0, 0] = 3.0
    assert (array(inpainting.inpaint(frame(spark, a), grid(a), "z"), a.shape, "z") == 3.0).all()


@pytest.mark.parametrize("order", [1, -1])
def test_lowest_in_any_order(spark, order):
    rows = [(0.5, 0.5, 110.0), (0.6, 0.6, 100.0)][::order]
    d = spark.createDataFrame(rows, "x double, y double, z double")
    assert raster.lowest(d, Grid(0, 0, 2, 2, 1.0, 2, 2)).first().z == 100.0


def test_stat_grid(spark):
    rows = [(0.5, 0.5, 10.0, 4.0), (0.4, 0.4, 9.0, 2.0), (0.4, 0.4, 8.0, 50.0), (1.5, 0.5, 1.0, 6.0)]
    g = Grid(0, 0, 2, 2, 1.0, 2, 2)
    d = g.with_index(spark.createDataFrame(rows, "x double, y double, z double, red double"))
    got = {(r.r, r.c): (r.surface_z, r.n, r.red, r.void) for r in raster.stat_grid(d, g, ["red"]).collect()}
    assert got == {(1, 0): (10.0, 2, 3.0, False), (1, 1): (1.0, 1, 6.0, False), (0, 0): (None, None, None, True), (0, 1): (None, None, None, True)}


def test_cloth_separates_a_box_from_the_plane(spark):
    rng = np.random.default_rng(0)
    n = 8000
    xy = rng.uniform(0, 200, (n, 2))
    box = ((xy > 80) & (xy < 120)).all(1)
    z = 100 + rng.normal(0, 0.05, n) + 20 * box
    keep = cloth.simulate(np.column_stack([xy, z]))
    assert not keep[box].any() and keep[~box].mean() > 0.9
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(xy, z)], "x double, y double, z double")
    assert cloth.ground(d).agg(F.max("z")).first()[0] < 105
    assert len(cloth.simulate(np.zeros((0, 3)))) == 0
