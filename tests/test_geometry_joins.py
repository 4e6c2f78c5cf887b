"""Joins by cells against brute force: the nearest point of another class, overlapping boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import boxes, matching

POINT = "orig_index long, x double, y double, z double, classification int"


def frame(spark, xyz, codes):
    return spark.createDataFrame([(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(xyz, codes))], POINT).repartition(4)


def near(xyz, codes, radius):
    out = np.zeros(len(xyz), bool)
    ok = np.isin(codes, [3, 5, 6, 11, 64])
    for i in range(0, len(xyz), 500):
        part = slice(i, i + 500)
        d = ((xyz[part, None, :] - xyz[None, :, :]) ** 2).sum(2) <= radius * radius
        out[part] = (d & (codes[None, :] != codes[part, None]) & ok[None, :]).any(1)
    return out & ok


def got(d):
    return {r.orig_index: r.boundary for r in d.collect()}


@pytest.mark.parametrize("compared", [1, 64, 1 << 16])
def test_nearest_other_class_by_brute_force(spark, monkeypatch, compared):
    monkeypatch.setattr(matching, "COMPARED", compared)
    rng = np.random.default_rng(compared)
    xyz = np.round(rng.random((700, 3)) * (6, 6, 2) * 8) / 8  # on a lattice, so distances meet the radius exactly
    codes = rng.choice([3, 5, 6, 0], 700, p=[0.6, 0.2, 0.1, 0.1])
    for radius in (0.25, 0.5, 1.0):
        want = near(xyz, codes, radius)
        assert got(matching.near_other_class(frame(spark, xyz, codes), radius)) == {i: bool(want[i]) for i in range(700) if codes[i] != 0}


def test_a_crowded_voxel_is_split(spark, monkeypatch):
    """Two classes of 6,000 points each in one voxel, a gap near the radius between them: few comparisons, right answers."""
    monkeypatch.setattr(matching, "COMPARED", 1000)
    rng = np.random.default_rng(5)
    a, b = rng.random((6000, 3)) * (0.45, 0.9, 0.9), rng.random((6000, 3)) * (0.2, 0.9, 0.9) + (0.79, 0, 0)
    xyz, codes = np.concatenate((a, b)), np.repeat([3, 5], 6000)
    radius = 0.6
    place = frame(spark, xyz, codes).drop("orig_index").distinct()
    decided, compared = matching.other_class_pairs(place, radius)
    sizes = 0
    for level, pairs in compared:
        for p in pairs.collect():
            count = lambda k: (np.floor(xyz / (radius * (1 + 1e-9)) * 2**level) == [p[f"{k}ix"], p[f"{k}iy"], p[f"{k}iz"]]).all(1) & (codes == p[f"{k}classification"])  # noqa: B023, E731
            piece = int(count("a").sum()) * int(count("b").sum())
            assert 0 < piece <= 1000
            sizes += piece
    assert len(compared) > 1 and 0 < sizes < 2 * 6000 * 6000 / 4
    want = near(xyz, codes, radius)
    assert got(matching.near_other_class(frame(spark, xyz, codes), radius)) == {i: bool(w) for i, w in enumerate(want)} and 0 < want.sum() < len(want)


def test_nearest_edges(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 3), (1, 1.0, 1.0, 1.0, 5), (2, None, 1.0, 1.0, 5), (3, 5.0, 5.0, 5.0, 3), (3, 5.0, 5.0, 5.0, 3), (4, 5.0, 5.0, 5.0, 1)], POINT)
    assert sorted((r.orig_index, r.boundary) for r in matching.near_other_class(d).collect()) == [(0, True), (1, True), (2, False), (3, False), (3, False)]
    assert matching.near_other_class(d.where("false")).collect() == []


def test_overlapping_boxes_by_brute_force(spark):
    rng = np.random.default_rng(6)

    def some(n, first):
        side = 2.0 ** rng.integers(-4, 7, n)
        low = np.round(rng.random((n, 2)) * 64 - 32, 2)
        return [(first + i, int(i % 3), [float(x), float(y), float(x + s), float(y + s * rng.choice([0.5, 1, 3]))]) for i, ((x, y), s) in enumerate(zip(low, side))]

    a, b = some(120, 0), some(90, 1000)
    odd = [(500, 0, None), (501, 0, [1.0, 1.0, 1.0, 5.0]), (502, 1, [5.0, 5.0, 1.0, 9.0]), (503, 1, [float("nan"), 0.0, 1.0, 1.0]), (504, 2, [0.0, 0.0, None, 1.0]), (505, 2, [0.0, 0.0, float("inf"), 1.0])]
    schema = "k long, tile int, bbox array<double>"
    d = boxes.overlapping(spark.createDataFrame(a + odd, schema).repartition(3), spark.createDataFrame(b, schema), ["tile"], ("k", "k"))
    want = {}
    for i, t, p in a:
        for j, u, q in b:
            area = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
            if t == u and area > 0:
                want[t, i, j] = area
    rows = d.collect()
    assert len(rows) == len(want) and {(r.tile, r.k1, r.k2): r.overlap for r in rows} == pytest.approx(want)
    assert boxes.overlapping(d.select("tile", F.col("k1").alias("k"), F.lit(None).cast("array<double>").alias("bbox")), spark.createDataFrame(b, schema), ["tile"], ("k", "k")).collect() == []


def test_small_boxes_far_apart_make_no_pairs(spark):
    """20,000 boxes in a row and one over all of them: the join's rows are those that overlap, not the square."""
    d = spark.range(20_000).select("id", F.array(F.col("id") * 2.0, F.lit(0.0), F.col("id") * 2.0 + 1, F.lit(1.0)).alias("bbox"))
    cover = spark.createDataFrame([(1, [0.0, 0.0, 40_000.0, 0.5])], "id long, bbox array<double>")
    assert boxes.overlapping(d, d, [], ("id", "id")).count() == 20_000
    assert boxes.overlapping(d, cover, [], ("id", "id")).agg(F.sum("overlap")).first()[0] == 10_000.0


def test_box_joins_broadcast_no_side(spark):
    """A side grows with its table, though Spark's estimate of it stays small; edges that meet on a cell's border count nothing."""
    d = spark.range(400).select("id", F.array(F.col("id") % 20 * 4.0, F.floor(F.col("id") / 20) * 4.0, F.col("id") % 20 * 4.0 + 4, F.floor(F.col("id") / 20) * 4.0 + 4).alias("bbox"))
    met = boxes.overlapping(d, d, [], ("id", "id"))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in met.orderBy("k1").collect()] == [(i, i, 16.0) for i in range(400)]
