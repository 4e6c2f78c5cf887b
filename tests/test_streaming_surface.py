"""Near-surface means over a stream equal those of the whole, in any order and batching."""

import numpy as np
import pytest

from cellgrove.operators import raster
from cellgrove.operators.grid import Grid
from cellgrove.streaming import near_surface

SCHEMA = "x double, y double, z double, red int, hag double"


def points(seed=1, n=400):
    rng = np.random.default_rng(seed)
    return [(float(rng.integers(0, 64) / 16), float(rng.integers(0, 64) / 16), None if i % 90 == 5 else float(rng.integers(0, 60) / 8 + i / 64), int(rng.integers(0, 9)), None if i % 7 == 0 else float(rng.integers(0, 40) / 8)) for i in range(n)]


@pytest.mark.parametrize("order, sizes", [("up", (1, 50, 349)), ("down", (200, 200)), ("mixed", (400,)), ("mixed", (90, 10, 100, 100, 100))])
def test_means_of_a_stream(spark, tmp_path, order, sizes):
    rows = points()
    rows = rows if order == "up" else rows[::-1] if order == "down" else [rows[i] for i in np.random.default_rng(2).permutation(len(rows))]
    g = Grid(0, 0, 4, 4, 1.0, 4, 4)
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    at = 0
    for n in sizes:
        spark.createDataFrame(rows[at : at + n], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        at += n
        near_surface.maintain(spark.readStream.schema(SCHEMA).parquet(src), g, ["red", "hag"], out, cp).awaitTermination(200)
    d = g.with_index(spark.createDataFrame(rows, SCHEMA))
    top = raster.surface_max(d)
    want = top.join(raster.near_surface_means(d, top, g, ["red", "hag"]), ["r", "c"]).collect()
    got = near_surface.latest(spark, out).select("r", "c", "surface_z", "n", "red", "hag").collect()
    assert len(want) == 16 and sorted(map(tuple, got)) == sorted(map(tuple, want))
