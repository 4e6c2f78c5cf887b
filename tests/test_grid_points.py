import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import audit, points
from cellgrove.operators.grid import Grid, GridConflict

TABLE = "orig_index long, x double, y double, z double"


def test_grid_of_two_points(spark, tmp_path):
    d = spark.createDataFrame([(0, 10.0, 20.0, 1.0), (1, 12.25, 23.0, 2.0)], TABLE)
    g = Grid.of_points(d, 0.5)
    assert (g.rows, g.cols) == (6, 5)
    path = str(tmp_path / "grid.json")
    g.save_once(path)
    g.save_once(path)
    with pytest.raises(GridConflict):
        Grid.of_points(d, 1.0).save_once(path)


@pytest.mark.parametrize("resolution", [0.0, -0.5, math.nan, math.inf])
def test_bad_resolutions(resolution):
    with pytest.raises(ValueError):
        Grid.of(0, 0, 1, 1, resolution)


def test_bad_bounds(spark):
    with pytest.raises(ValueError):
        Grid.of(1, 0, 0, 1, 0.5)
    with pytest.raises(ValueError):
        Grid.of_points(spark.createDataFrame([], TABLE), 0.5)
    assert Grid.of(3, 3, 3, 3, 0.5).rows == 1


def test_index_truncates_and_clips(spark):
    g = Grid.of(0, 0, 4, 4, 1)
    d = spark.createDataFrame([(0, -0.5, 4.5, 0.0), (1, 4.0, 0.0, 0.0), (2, 1.5, 2.5, 0.0), (3, 99.0, -99.0, 0.0)], TABLE)
    got = {r.orig_index: (r.r, r.c) for r in g.with_index(d).collect()}
    assert got == {0: (0, 0), 1: (3, 3), 2: (1, 1), 3: (3, 3)}


def test_crops(spark):
    d = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], TABLE)
    ids = lambda x: sorted(r[0] for r in x.select("orig_index").collect())
    assert ids(points.crop(d, (1, 0, 3, 1))) == [1, 2, 3]
    assert ids(points.crop(d, (1, 0, 3, 1), closed=False)) == [1, 2]
    with pytest.raises(ValueError):
        points.crop(d, (8, 8, 9, 9), require=True)


def test_ordinals_of_many_rows(spark):
    """Positions stay dense when the rows carry further columns: every branch must cut the same ranges."""
    d = spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("orig_index"), F.col("id").alias("kept"))
    r = points.ordinal(d).agg(F.countDistinct("ordinal").alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("z"), F.countDistinct("kept").alias("k")).first()
    assert tuple(r) == (400_000, 0, 399_999, 400_000)


def test_running_sums_over_ties_nulls_and_nothing(spark):
    d = spark.createDataFrame([(None, 1), (5, 2), (5, 3), (-7, 4), (1 << 40, 5)], "k long, n long")
    s = points.running_sum(d, "k", F.col("n"), "upto").collect()
    assert sorted(r.upto for r in s if r.k != 5) == [1, 5, 15] and max(r.upto for r in s if r.k == 5) == 10
    assert points.running_sum(d.limit(0), "k", F.col("n"), "upto").collect() == []


def test_quantiles_from_ranges(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.normal(size=20_001), np.repeat(0.25, 5_000)))
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    q = audit.quantiles(d, "v").first()
    assert q.n == len(v) and np.allclose([q.least, q.median, q.p90, q.p99, q.most, q["mean"]], [*np.quantile(v, [0, 0.5, 0.9, 0.99, 1]), v.mean()])
    assert tuple(audit.quantiles(d.limit(0), "v").first()) == (0, None, None, None, None, None, None)


def test_ordinals_and_thinning(spark):
    d = spark.range(1000).select((F.col("id") * 3 + 5).alias("orig_index"), F.rand(1).alias("x")).repartition(7)
    o = {r.orig_index: r.ordinal for r in points.ordinal(d).collect()}
    assert o == {i * 3 + 5: i for i in range(1000)}
    assert sorted(r[0] for r in points.thin(d, 12).select("orig_index").collect()) == [i * 3 + 5 for i in range(0, 1000, 12)]


def test_samples_repeat(spark):
    d = spark.range(500).select(F.col("id").alias("orig_index"), (F.col("id") % 3).alias("stratum"))
    a = [r[0] for r in points.sample(d, 50, 3).collect()]
    assert a == [r[0] for r in points.sample(d.repartition(5), 50, 3).collect()] and len(set(a)) == 50
    chosen, counts = points.stratified(d, "stratum", 50)
    assert chosen.groupBy("stratum").count().where("count <> 50").isEmpty()
    assert {r.available for r in counts.collect()} == {166, 167}


def test_unique(spark):
    d = spark.createDataFrame([(1,), (1,)], "orig_index long")
    with pytest.raises(ValueError):
        points.require_unique(d)
    with pytest.raises(ValueError):
        points.require_unique(spark.createDataFrame([(-1,)], "orig_index long"))
