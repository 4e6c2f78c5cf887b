"""Interval masks against plain arrays: cutting, sweeping, stretching, encoding."""

import numpy as np
from pyspark.sql import functions as F

from cellgrove.operators import intervals, masks

ROW = "id int, counts array<int>, h int, w int, score float"


def rle(a):
    flat = a.ravel().astype(int)
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], edges, [flat.size]))).tolist()
    return [0, *runs] if flat[0] else runs


def some(seed, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w = (int(v) for v in rng.integers(1, 14, 2))
        a = rng.random((h, w)) < rng.choice([0, 0.1, 0.5, 1])
        out.append((i, a, float(np.float32(rng.integers(0, 5) / 4))))
    return out


def frame(spark, found):
    return spark.createDataFrame([(i, rle(a), *a.shape, s) for i, a, s in found], ROW)


def painted(rows, shape):
    a = np.zeros(shape, bool)
    for r in rows:
        assert 0 <= r.b < r.e <= shape[1] and not a[r.r, r.b : r.e].any()
        a[r.r, r.b : r.e] = True
    return a


def test_runs_become_intervals(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TOGETHER", 7)
    found = some(1)
    d = frame(spark, found).unionByName(spark.createDataFrame([(900, None, 3, 3, 1.0), (901, [0, 5], 1, None, 1.0), (902, [], 0, 0, 1.0)], ROW))
    got = intervals.of_runs(d).collect()
    for i, a, s in found:
        own = [r for r in got if r.id == i]
        assert (painted(own, a.shape) == a).all() and {r.score for r in own} <= {np.float32(s)}
    assert {r.id for r in got} <= {i for i, *_ in found}
    assert intervals.of_runs(d.where("false")).collect() == []


def test_union_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 5 == 0 else "ab"[k % 2], int(rng.integers(0, 3)), int(b), int(b + rng.integers(0, 30)), None if k % 50 == 7 else float(rng.integers(1, 6) / 8)) for k, b in enumerate(rng.integers(0, 200, 3000))]
    d = spark.createDataFrame(rows, "tile string, r int, b int, e int, score double").repartition(6)
    want: dict = {}
    for t, r, b, e, s in rows:
        if s is not None:
            a = want.setdefault((t, r), np.zeros(260))
            a[b:e] = np.maximum(a[b:e], s)
    for size in ("10", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = intervals.union(d, ["tile"]).collect()
        have = {k: np.zeros(260) for k in want}
        for x in sorted(got, key=lambda x: (str(x.tile), x.r, x.b)):
            a = have[x.tile, x.r]
            assert x.b < x.e and not a[x.b : x.e].any() and (x.b == 0 or a[x.b - 1] != x.score)  # disjoint, neighbours joined
            a[x.b : x.e] = x.score
        assert all((have[k] == want[k]).all() for k in want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert intervals.union(d.where("false"), []).collect() == []


def test_union_of_one_crowded_row(spark):
    """60,000 overlapping intervals of one image row come out as one, without a row for each pixel."""
    d = spark.range(0, 60_000, 1, 6).select(F.lit(0).alias("r"), (F.col("id") * 3).cast("int").alias("b"), (F.col("id") * 3 + 10**6).cast("int").alias("e"), F.lit(0.5).alias("score"))
    assert [tuple(x) for x in intervals.union(d, []).collect()] == [(0, 0, 59_999 * 3 + 10**6, 0.5)]


def test_masks_stretch_to_their_image(spark):
    rng = np.random.default_rng(3)
    found = some(4)
    sizes = {i: (int(rng.integers(1, 30)), int(rng.integers(1, 30))) for i, *_ in found}
    image = spark.createDataFrame([(i, *v) for i, v in sizes.items()], "id int, tile_h int, tile_w int")
    d = frame(spark, found).join(image, "id")
    got = {r.id: r for r in masks.resized(d.withColumn("note", F.lit("kept")), ["id"]).collect()}
    assert len(got) == len(found)
    for i, a, _ in found:
        h, w = sizes[i]
        want = a[((2 * np.arange(h) + 1) * a.shape[0] // (2 * h))[:, None], (2 * np.arange(w) + 1) * a.shape[1] // (2 * w)]
        assert (got[i].h, got[i].w, got[i].note, got[i].counts) == (h, w, "kept", rle(want))
    broken = spark.createDataFrame([(1, [3], 2, 2, 1.0, 4, 4)], ROW + ", tile_h int, tile_w int")
    assert masks.resized(broken, ["id"]).collect() == []


def test_runs_of_intervals_round_trip(spark):
    found = some(5)
    d = frame(spark, found)
    got = {r.id: r.counts for r in intervals.runs_of(intervals.of_runs(d), d, ["id"]).collect()}
    assert got == {i: rle(a) for i, a, _ in found}


def test_boxes_and_coverage(spark):
    found = some(6)
    d = frame(spark, found)
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in intervals.boxes(intervals.of_runs(d), d, ["id"]).collect()}
    for i, a, _ in found:
        r, c = np.nonzero(a)
        assert got[i] == ((c.min(), r.min(), c.max() + 1, r.max() + 1) if len(r) else (0, 0, 0, 0))
    cut = intervals.of_runs(d.withColumn("class", F.col("id") % 3))
    for r in intervals.coverage(intervals.union(cut, ["class"]), 200).collect():
        a = np.zeros((14, 14), np.float32)
        for i, m, s in found:
            if i % 3 == r["class"]:
                a[: m.shape[0], : m.shape[1]] = np.maximum(a[: m.shape[0], : m.shape[1]], np.where(m, s, 0))
        assert r.coverage == (a > np.float32(0.1)).sum() / 200 and r.top == a.max()
