"""The component matrix against its configurations one by one, window sums against plain arrays, one scan of the points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.config import IDS
from cellgrove.functions.scalar import f32
from cellgrove.operators import metrics, stencil
from cellgrove.operators.grid import Grid
from cellgrove.plans import experiments


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    """Random cells with four sources, and points over them."""
    rng = np.random.default_rng(8)
    g = Grid(0, 0, 12, 9, 1.0, 9, 12)
    path = str(tmp_path_factory.mktemp("matrix"))
    cells = []
    for r in range(9):
        for c in range(12):
            void = bool(rng.random() < 0.15)
            cells.append((r, c, None if void else float(rng.random() * 0.3 - 0.05), None if void else float(rng.random() * 12), void, None if void else float(rng.random() * 10), *(float(v) for v in rng.random(28))))
    names = [f"{n}_{k}" for k in range(4) for n in IDS]
    d = spark.createDataFrame(cells, "r int, c int, exg float, hag float, void boolean, surface_z float, " + ", ".join(f"{n} float" for n in names))
    d.coalesce(1).write.parquet(f"{path}/cells")
    pts = [(i, int(rng.integers(0, 9)), int(rng.integers(0, 12)), float(rng.random() * 12), float(rng.random() * 10), float(rng.random() * 0.3 - 0.05), int(rng.choice([3, 5, 6, 11, 64, 1, 0]))) for i in range(600)]
    spark.createDataFrame(pts, "orig_index long, r int, c int, z double, hag float, exg float, ref int").coalesce(1).write.parquet(f"{path}/points")
    d = spark.read.parquet(f"{path}/cells")
    sources = {s: {n: F.col(f"{n}_{k}") for n in IDS} for k, s in enumerate(("rules", "neural", "neural_0.5", "neural_1"))}
    return spark.read.parquet(f"{path}/points"), g, d, sources


def test_matrix_equals_each_configuration(spark, survey):
    points, g, cells, sources = survey
    got = experiments.matrix(points, g, (cells, sources)).collect()
    apart = {s: cells.select("r", "c", "exg", "hag", "void", "surface_z", *[c.alias(n) for n, c in by.items()]) for s, by in sources.items()}
    names = {c.name: c for c in experiments.configurations()}
    assert {r.method for r in got} == set(names)
    for name in ("geometry_only", "point_rules", "rules_c0_s0_naive", "rules_c1_s1_height_aware", "neural_c0_s1_naive", "both", "tree_height", "physical_smoothing", "transfer_band_1.5", "majority_1", "majority_3", "majority_9", "bbox_0.5", "bbox_1"):
        one = metrics.confusion_strict(experiments.predict(names[name], points, g, apart)).collect()
        assert {(r.reference, r.prediction, r["count"]) for r in got if r.method == name} == {(r.reference, r.prediction, r["count"]) for r in one}, name
    few = [names["neural_c1_s1_naive"], names["bbox_1"]]
    assert sorted(map(tuple, experiments.matrix(points, g, apart, few).collect())) == sorted((r.reference, r.prediction, r.method, r["count"]) for r in got if r.method in {c.name for c in few})


def test_matrix_scans_the_points_once(survey):
    points, g, cells, sources = survey
    plan = experiments.matrix(points, g, (cells, sources))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ref#") > 0 and sum("parquet" in x and "orig_index" in x for x in plan.splitlines()) == 1


@pytest.mark.parametrize("sizes", [(1,), (2, 3), (5, 17, 65), (4, 9)])
def test_window_sums_by_brute_force(spark, sizes):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 9, (7, 11)).astype(float)
    g = Grid(0, 0, 11, 7, 1.0, 7, 11)
    rows = [(r, c, None if (r + c) % 6 == 0 else float(a[r, c])) for r in range(7) for c in range(11)]
    a[np.add.outer(np.arange(7), np.arange(11)) % 6 == 0] = 0
    d = spark.createDataFrame(rows, "r int, c int, v double").withColumn("note", F.lit("kept"))
    got = {(r.r, r.c): r for r in stencil.window_sums(d, g, {"s": (F.col("v"), sizes), "t": (F.col("v") * 2, sizes[:1])}).collect()}
    for size in sizes:
        low, high = size // 2, size - size // 2 - 1
        for r in range(7):
            for c in range(11):
                y, x = np.clip(np.arange(r - low, r + high + 1), 0, 6), np.clip(np.arange(c - low, c + high + 1), 0, 10)
                assert got[r, c][f"s_{size}"] == a[np.ix_(y, x)].sum() and got[r, c].note == "kept"
                if size == sizes[0]:
                    assert got[r, c][f"t_{size}"] == 2 * a[np.ix_(y, x)].sum()


def test_plan_does_not_grow_with_the_window(spark):
    g = Grid(0, 0, 30, 30, 1.0, 30, 30)
    d = g.cells(spark).withColumn("z", f32(F.col("r")))
    plans = [stencil.box_mean(d, g, s, "z")._jdf.queryExecution().optimizedPlan().toString() for s in (3, 65)]
    assert len({(p.count("Window"), p.count("sum(")) for p in plans}) == 1
