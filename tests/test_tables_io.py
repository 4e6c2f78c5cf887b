"""Detector clients, arrays, subsets, parts, digests, sampling of rasters, guards and the command line."""

import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove import __main__ as cli
from cellgrove import queries_tables
from cellgrove.operators import inpainting, masks, matching, metrics, points, stencil
from cellgrove.operators.grid import Grid
from cellgrove.plans import guard
from cellgrove.sources import las, npy, sinks, tiles


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/slow":
                time.sleep(1.5)
            body = {"/text": b"no json", "/lacks": b"{}"}.get(self.path, json.dumps({p: [] for p in asked["prompts"]}).encode())
            self.send_response(503 if self.path == "/busy" else 200)
            self.end_headers()
            self.wfile.write(body)

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_detector(server):
    assert json.loads(tiles.http_detector(server)(b"png", ["a", "b"])) == {"a": [], "b": []}
    for path, error in (("/busy", tiles.BadStatus), ("/text", tiles.BadAnswer), ("/lacks", tiles.BadAnswer)):
        with pytest.raises(error):
            tiles.http_detector(server + path)(b"", ["a"])
    with pytest.raises(tiles.TimedOut):
        tiles.http_detector(server + "/slow", timeout=0.2)(b"", ["a"])
    with pytest.raises(tiles.Unreachable):
        tiles.http_detector("http://127.0.0.1:9")(b"", ["a"])


def test_jobs(spark):
    images = spark.createDataFrame([("a.png", b"1"), ("b.png", b"2")], "path string, content binary")
    every = tiles.jobs(images, ["car", "tree"], "model-1")
    assert every.count() == 4 and every.select("key").distinct().count() == 4
    assert tiles.jobs(images, ["car", "tree"], "model-1", every.limit(3)).count() == 1 and tiles.jobs(images, ["car"], "model-2", every).count() == 2


def test_npy_round_trips(spark, tmp_path):
    d = spark.range(1000, 0, -1).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("x"), F.col("id").cast("int").alias("n")).repartition(5)
    npy.write_npy(d, str(tmp_path / "p.npy"), {"x": "<f8", "n": "<u2"}, "k")
    a = np.load(tmp_path / "p.npy")
    assert a["n"].tolist() == list(range(1, 1001)) and a["x"][3] == 2.0
    back = npy.read_npy(spark, str(tmp_path / "p.npy"), rows=300)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, (i + 1) * 0.5, i + 1) for i in range(1000)]
    with pytest.raises(FileExistsError):
        npy.write_npy(d, str(tmp_path / "p.npy"), {"x": "<f8"}, "k")
    g = Grid(0, 0, 7, 5, 1.0, 5, 7)
    cells = g.cells(spark).withColumns({"z": (F.col("r") * 10 + F.col("c")).cast("float"), "v": F.col("c") > 3})
    npy.write_grid(cells, str(tmp_path / "g"), 5, 7, {"z": "<f4", "v": "?"})
    assert np.load(tmp_path / "g" / "z.npy")[2, 6] == 26
    assert sorted(map(tuple, npy.read_grid(spark, str(tmp_path / "g"), ["z", "v"]).collect())) == sorted(map(tuple, cells.select("r", "c", "z", "v").collect()))


def test_parts_are_checked(spark):
    tile = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(10)], "orig_index long, x double, y double, z double")
    part = tile.where("orig_index < 3")
    moved = part.withColumn("x", F.col("x") + F.when(F.col("orig_index") == 1, 0.02).otherwise(0.005))
    near = part.withColumn("x", F.col("x") + 0.005)
    assert {r.orig_index: r.classification for r in matching.merge_parts(tile, {5: near}).collect()} == {i: 5 if i < 3 else 1 for i in range(10)}
    for bad in (moved, part.unionByName(part), part.withColumn("orig_index", F.col("orig_index") + 8)):
        with pytest.raises(matching.AlignmentError):
            matching.merge_parts(tile, {5: bad})


def test_geometry_needs_one_scale(spark):
    d = spark.createDataFrame([(1, 5, 5, 5), (2, 6, 6, 6)], "orig_index long, x_raw int, y_raw int, z_raw int")
    one = las.Header(0, 0, 0, (0.01,) * 3, (0.0,) * 3, (0.0,) * 3, (0.0,) * 3, ())
    other = las.Header(0, 0, 0, (0.001,) * 3, (0.0,) * 3, (0.0,) * 3, (0.0,) * 3, ())
    assert matching.geometry_mismatches(d, d, headers=(one, one)).first().differing == 0 and matching.geometry_mismatches(d, d, headers=(one, other)).first().differing == 2


def test_ordered_digest_by_hand(spark):
    rows = [(i * 3, i % 5, None if i % 7 == 0 else f"t{i}") for i in range(1000)]
    d = spark.createDataFrame(rows, "k long, a long, b string").repartition(6)
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    level = [f"{a},{b or ''}" for _, a, b in rows]
    while len(level) > 1:
        level = [sha(level[i : i + 8]) for i in range(0, len(level), 8)]
    assert tuple(points.ordered_digest(d, ["a", "b"], "k", 8).first()) == (1000, level[0])
    assert points.ordered_digest(d.where("false"), ["a", "b"], "k").first().rows == 0


def test_flat_digest_has_two_levels(spark):
    d = spark.range(1000).select(F.col("id").alias("k")).repartition(6)
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    for n in (8, 9, 1000):  # one block, two, and more blocks than a block has rows
        want = [sha(map(str, range(i, min(n, i + 8)))) for i in range(0, n, 8)]
        got = points.ordered_digest(d.where(F.col("k") < n), ["k"], "k", 8, flat=True)
        assert got.collect() == [(n, sha(want) if len(want) > 1 else want[0])]


def test_ordered_digest_query_has_the_levels_of_its_sql(spark, tmp_path):
    """Above 1,000,000 points there are more blocks than a block has rows."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(1_000_001).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.sql(queries_tables.oracle_sql()["q_ordered_digest"]).fetchall()
    assert [tuple(r) for r in queries_tables.queries()["q_ordered_digest"](spark, str(tmp_path)).collect()] == want


def bilinear_by_hand(a, y, x):
    total = 0.0
    for i in (0, 1):
        for j in (0, 1):
            r, c = int(np.floor(y)) + i, int(np.floor(x)) + j
            if 0 <= r < a.shape[0] and 0 <= c < a.shape[1]:
                total += a[r, c] * (y - np.floor(y) if i else 1 - (y - np.floor(y))) * (x - np.floor(x) if j else 1 - (x - np.floor(x)))
    return total


@pytest.mark.parametrize("small", [True, False])
def test_raster_sampling_by_hand(spark, small, monkeypatch):
    """Grids that are broadcast to their points, and grids too large for that."""
    monkeypatch.setattr(Grid, "small", lambda self: small)
    a, g = np.random.default_rng(2).random((6, 9)), Grid(0, 0, 9, 6, 1.0, 6, 9)
    cells = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(6) for c in range(9)], "r int, c int, v double")
    rng = np.random.default_rng(3)
    at = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-2, 8, 40), rng.uniform(-2, 11, 40)))]
    got = {r.id: r.sample for r in stencil.grid_sample(cells, g, spark.createDataFrame(at, "id long, y double, x double"), "v").collect()}
    assert got == pytest.approx({i: bilinear_by_hand(a, y, x) for i, y, x in at})
    boxes = [(0, [1.0, 1.0, 5.0, 4.0]), (1, [-3.0, -2.0, 12.0, 9.0])]
    got = {(r.box, r.i, r.j): r.value for r in stencil.roi_align(cells, g, spark.createDataFrame(boxes, "box long, bbox array<double>"), "v", (2, 3)).collect()}
    for k, (x0, y0, x1, y1) in boxes:
        for i in range(2):
            for j in range(3):
                s = []
                for p in range(2):
                    for q in range(2):
                        y, x = y0 - 0.5 + (i + (p + 0.5) / 2) * (y1 - y0) / 2, x0 - 0.5 + (j + (q + 0.5) / 2) * (x1 - x0) / 3
                        s.append(bilinear_by_hand(a, min(max(y, 0), 5), min(max(x, 0), 8)) if -1 <= y <= 6 and -1 <= x <= 9 else 0)
                assert got[k, i, j] == pytest.approx(np.mean(s))
    wide = stencil.bilinear(cells, g, Grid(0, 0, 9, 6, 0.5, 12, 18), "v")
    assert wide.count() == 12 * 18 and wide.where("dtm is null").isEmpty()


def test_inpainting_has_no_ring_limit(spark):
    g = Grid(0, 0, 40, 1, 1.0, 1, 40)
    d = g.cells(spark).withColumn("v", F.when(F.col("c") == 0, 7.0))
    assert {r.v for r in inpainting.inpaint(d, g, "v").collect()} == {7.0}
    assert inpainting.inpaint(d.withColumn("v", F.lit(None).cast("double")), g, "v").count() == 40


def test_masks_that_fit(spark):
    d = spark.createDataFrame([(1, [2, 2], 2, 2, 2, 2), (2, [2, 2], 2, 2, 3, 3), (3, [2, 3], 2, 2, 2, 2)], "id long, counts array<int>, h int, w int, tile_h int, tile_w int")
    assert [r.id for r in masks.fitting(d).collect()] == [1]


def test_recount_finds_errors(spark):
    d = spark.createDataFrame([(3, 3), (3, 5), (5, 5), (6, 1), (0, 3), (11, 77)], "ref int, pred int")
    classes, counted = metrics.per_class(metrics.confusion_strict(d)), metrics.recounted(d)
    assert metrics.disagreements(classes, counted).isEmpty()
    assert metrics.disagreements(classes.withColumn("true_positive", F.col("true_positive") + F.when(F.col("code") == 5, 1).otherwise(0)), counted).count() == 2


def test_rectangles():
    a = guard.Rect.of([0, 0, 4, 4])
    assert not a.meets(guard.Rect.of([4, 0, 8, 4])) and a.meets(guard.Rect.of([3.9, 3.9, 5, 5])) and a.holds(a) and not a.holds(guard.Rect.of([0, 0, 4, 5]))
    for bad in ([0, 0, 1], [0, 0, 0, 1], [0, 0, float("nan"), 1], [0, 0, True, 1], [0, 0, "1", 1]):
        with pytest.raises(guard.Refused):
            guard.Rect.of(bad)


def test_run_and_inventory(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"context": [0, 0, 9, 9], "protected": [[5, 5, 9, 9]]}))
    lock = sinks.sha256_file(str(p))
    run = guard.BoundedRun.prepare(guard.Protocol.load(str(p), lock), [0, 0, 4, 4], {str(p): lock}, str(tmp_path / "run"))

    def label():
        (tmp_path / "run" / "labels.csv").write_text("x")
        return {"labels": "labels.csv"}

    assert run.run(label, lambda: {"loss": 0.5}, {"window": 5}) == {"loss": 0.5}
    assert set(guard.inventory(str(tmp_path))) == {"p.json", "run/manifest.json"}
    kept = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert kept["settings"] == {"window": 5, "scores": {"loss": 0.5}} and "labels.csv" in kept["outputs"]
    guard.require_provenance({"identity": "m", "inputs": {"a": "1"}}, {"a": "1"}, "m")
    for record in ({"identity": "n", "inputs": {"a": "1"}}, {"identity": "m", "inputs": {"a": "2"}}, {}):
        with pytest.raises(guard.Refused):
            guard.require_provenance(record, {"a": "1"}, "m")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    """List and query; crops and merges keep the tile's scale."""
    cli.main(["list"])
    assert "q_surface_max" in capsys.readouterr().out
    las.register(spark)
    d = spark.createDataFrame([(i, i * 0.25, 1.0, 2.0, 1) for i in range(40)], "orig_index long, x double, y double, z double, classification short")
    d.coalesce(1).write.format("las").option("path", str(tmp_path / "tile")).option("scale", "0.25,0.25,0.25").option("offset", "1,0,0").mode("append").save()
    tile = str(next((tmp_path / "tile").glob("*.las")))
    cli.main(["crop", tile, str(tmp_path / "cut"), "0", "0", "3", "3"])
    cut = str(next(f for f in (tmp_path / "cut").glob("*.las") if las.Header.read(str(f)).count))
    assert las.Header.read(cut).scale == (0.25,) * 3 and las.Header.read(cut).shift == (1.0, 0.0, 0.0)
    assert spark.read.format("las").load(str(tmp_path / "cut")).count() == 13
    (tmp_path / "a_tree.las").write_bytes((tmp_path / "cut" / cut).read_bytes())
    cli.main(["merge", tile, str(tmp_path / "a_tree.las"), "--out", str(tmp_path / "merged")])
    got = spark.read.format("las").load(str(tmp_path / "merged"))
    assert got.count() == 40 and got.where("classification = 5").count() == spark.read.format("las").load(str(tmp_path / "a_tree.las")).count()
    with pytest.raises(SystemExit):
        cli.main(["merge", tile, str(tmp_path / "nothing.las"), "--out", str(tmp_path / "x")])
