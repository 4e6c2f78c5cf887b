import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import units
from cellgrove.operators.grid import Grid
from cellgrove.plans import experiments, guard, stages
from cellgrove.sources import las, sinks, tiles
from cellgrove.streaming import incremental


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    d = spark.range(1000).select(
        F.col("id").cast("int").alias("x_raw"), (F.col("id") * 2 - 700).cast("int").alias("y_raw"), F.lit(5).alias("z_raw"), (F.col("id") * 60).cast("int").alias("red"), F.lit(65535).alias("green"), F.lit(0).alias("blue"),
        F.lit(3).cast("tinyint").alias("return_number"), F.lit(5).cast("tinyint").alias("number_of_returns"), (F.col("id") % 7).cast("smallint").alias("classification"), (F.col("id") % 200).cast("smallint").alias("user_data"),
        (F.col("id") / 8).cast("float").alias("model_score"), (F.col("id") % 5).cast("smallint").alias("prediction_source"),
    ).coalesce(2)
    path = str(tmp_path / "out")
    d.write.format("las").option("path", path).option("scale", "0.01,0.01,0.01").option("offset", "100,0,0").mode("append").save()
    got = spark.read.format("las").option("path", path).option("chunk", "300").load()
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 1000
    cols = d.columns
    assert got.select(*cols).exceptAll(d.select(*[F.col(c).cast(got.schema[c].dataType) for c in cols])).isEmpty()
    r = got.where("x_raw = 7").first()
    assert r.x == 7 * 0.01 + 100 and r.orig_index >= 0 and got.select("orig_index").distinct().count() == 1000
    assert got.where("x > 500").count() == 0
    some = spark.read.format("las").option("path", path).option("columns", "orig_index,x").load()
    assert some.columns == ["orig_index", "x"]
    head = las.Header.read(las.paths_of(path)[0])
    whole = las.from_binary(spark.read.format("binaryFile").load(path), head)
    assert whole.agg(F.sum("red")).first()[0] == d.agg(F.sum("red")).first()[0]
    with pytest.raises(Exception):
        d.write.format("las").option("path", path).mode("append").save()


def test_las_rejects_other_files(tmp_path):
    p = tmp_path / "a.las"
    p.write_bytes(b"LASX" + bytes(400))
    with pytest.raises(las.LasError):
        las.Header.read(str(p))
    with pytest.raises(las.LasError):
        las.paths_of(str(tmp_path / "none"))


def test_detector_and_cache(spark, tmp_path):
    (tmp_path / "tile_r0_c768.png").write_bytes(sinks.png(1, 1, b"\1\2\3"))
    (tmp_path / "other.png").write_bytes(b"")
    t = tiles.tiles(spark, str(tmp_path))
    assert [(r.row0, r.col0) for r in t.collect()] == [(0, 768)]
    answer = json.dumps({"car": [{"mask_rle": {"counts": [0, 1], "size": [1, 1]}, "score": 0.5, "bbox": [0, 0, 1, 1]}]})
    out = tiles.detect(t, lambda image, prompts: answer, ["car"], "fixture")
    assert [(r.prompt, r.score, r.counts, r.col0) for r in tiles.parse(out).collect()] == [("car", 0.5, [0, 1], 768)]

    def fails(image, prompts):
        raise OSError("refused")

    with pytest.raises(Exception, match="refused"):
        tiles.detect(t, fails, ["car"], "fixture").collect()


def test_sinks(spark, tmp_path):
    sinks.create_json(str(tmp_path / "a.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.create_json(str(tmp_path / "a.json"), {})
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "b.json"), float("nan"))
    aside = sinks.archive(str(tmp_path), ["a.json", "none"])
    assert os.listdir(aside) == ["a.json"] and sinks.archive(str(tmp_path), ["none"]) is None
    cells = Grid(0, 0, 4, 4, 1.0, 4, 4).cells(spark).withColumns({c: F.col("r") * 10 for c in ("red8", "green8", "blue8")})
    assert sinks.write_tiles(cells, str(tmp_path / "t"), 4, 4, 3, 2).count() == 4
    assert sinks.blank_responses(cells, "r", ["x"]).where("x = ''").count() == 16


def test_units():
    wkt = 'PROJCS["a",UNIT["US survey foot",0.304800609601219]],VERT_CS["b",VERT_DATUM["North American 1988",2005],UNIT["US survey foot",0.304800609601219]]'
    assert units.require_survey_feet(wkt) == "North American 1988"
    for bad in ('UNIT["metre",1.0]', 'UNIT["foot",0.3048]', "none"):
        with pytest.raises(units.UnitError):
            units.require_survey_feet(bad)


def test_guard(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"context": [0, 0, 10, 10], "protected": [[4, 4, 6, 6]], "development": [[0, 0, 4, 4]]}))
    p = guard.Protocol.load(str(path), sinks.sha256_file(str(path)))
    assert p.require_free([6, 4, 8, 6]) == (6.0, 4.0, 8.0, 6.0)
    for bad in ([5, 5, 7, 7], [3, 3, 1, 1], [0, 0, float("nan"), 1], [0, 0, 1]):
        with pytest.raises(guard.Refused):
            p.require_free(bad)
    with pytest.raises(guard.Refused):
        guard.Protocol.load(str(path), "0" * 64)
    gate = guard.Gate(str(tmp_path / "gate"))
    with pytest.raises(guard.Refused):
        gate.finish({})
    gate.begin({"a": 1})
    gate.finish({"b": 2})
    for again in (gate.begin, gate.finish):
        with pytest.raises(guard.Refused):
            again({})
    with pytest.raises(guard.Refused):
        guard.inside_folder(str(tmp_path), "../x")
    m = guard.manifest(str(tmp_path), ["p.json"])
    guard.verify_manifest(str(tmp_path), m)
    path.write_text("{}")
    with pytest.raises(guard.Refused):
        guard.verify_manifest(str(tmp_path), m)


def test_stages(tmp_path):
    ran = []
    s = stages.Stages().add("a", lambda: ran.append("a")).add("b", lambda: ran.append("b"), (str(tmp_path / "none"),))
    with pytest.raises(stages.StageError):
        s.run()
    assert ran == ["a"] and s.run("a") == ["a"]
    with pytest.raises(stages.StageError):
        s.plan("c")


def test_configurations():
    c = experiments.configurations()
    assert len(c) == 28 == len({x.name for x in c})
    assert sum(x.learned for x in c) == 18


def terrain_points(spark):
    i, j = np.meshgrid(np.arange(64), np.arange(64))
    rows = [(k, float(a), float(b), 800 + 0.01 * float(a), 20000, 30000, 20000) for k, (a, b) in enumerate(zip(i.ravel(), j.ravel()))]
    return spark.createDataFrame(rows, "orig_index long, x double, y double, z double, red int, green int, blue int")


def test_pipeline_on_a_slope(spark):
    p = terrain_points(spark)
    g = Grid.of_points(p, 0.5)
    assert (g.rows, g.cols) == (126, 126)
    out = stages.label(p, g, keep=lambda d: d.checkpoint()).checkpoint()
    assert out.where("hag is not null").count() == 4096 and out.agg(F.max(F.abs("hag"))).first()[0] < 0.5
    assert {r[0] for r in out.where("prediction_source = 1").select("las_code").distinct().collect()} == {3}


def test_matrix(spark):
    p = terrain_points(spark).limit(500)
    g = Grid.of_points(p, 4.0)
    d = g.with_index(stages.features(p)).withColumns({"hag": F.lit(0.5).cast("float"), "ref": F.lit(3)})
    from cellgrove.operators import raster

    cells = stages.rule_cells(raster.stat_grid(d, g, ["exg", "hag"]).withColumns({"exg": F.col("exg").cast("float"), "hag": F.col("hag").cast("float")}))
    chosen = [c for c in experiments.configurations() if c.name in ("geometry_only", "rules_c1_s1_height_aware", "rules_c0_s0_naive")]
    counts = experiments.matrix(d, g, {"rules": cells}, chosen).checkpoint()
    assert counts.select("method").distinct().count() == 3 and counts.agg(F.sum("count")).first()[0] == 1500
    assert experiments.select_final(counts, chosen, {}).first().name == "geometry_only"


def test_streaming_extremes(spark, tmp_path):
    g = Grid(0, 0, 4, 4, 1.0, 4, 4)
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "x double, y double, z double"
    for z in (1.0, 5.0, -2.0):
        spark.createDataFrame([(0.5, 0.5, z)], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.maintain(spark.readStream.schema(schema).parquet(src), g, out, cp).awaitTermination(120)
    r = incremental.latest(spark, out).collect()
    assert [(x.highest, x.lowest, x.n) for x in r] == [(5.0, -2.0, 3)]


def test_titles_differ():
    c = experiments.configurations()
    assert len({experiments.title(x) for x in c}) >= 26 and "band 1.5" in experiments.title(next(x for x in c if x.name == "transfer_band_1.5"))


def test_bounded_run(tmp_path):
    import subprocess

    path = tmp_path / "p.json"
    path.write_text(json.dumps({"context": [0, 0, 10, 10], "protected": [[4, 4, 6, 6]]}))
    digest = sinks.sha256_file(str(path))
    p = guard.Protocol.load(str(path), digest)
    run = guard.BoundedRun.prepare(p, [0, 0, 4, 4], {str(path): digest}, str(tmp_path / "run"))
    (tmp_path / "run" / "out.csv").write_text("a")
    run.record(["out.csv"], {"seed": 1})
    assert json.loads((tmp_path / "run" / "manifest.json").read_text())["outputs"]["out.csv"] == sinks.sha256_file(str(tmp_path / "run" / "out.csv"))
    for bounds, inputs in (([5, 5, 7, 7], {}), ([8, 8, 12, 12], {}), ([0, 0, 1, 1], {str(path): "0" * 64})):
        with pytest.raises(guard.Refused):
            guard.BoundedRun.prepare(p, bounds, inputs, str(tmp_path / "other"))
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c"]
    for step in (["init", "-q"], ["add", "p.json"], ["commit", "-qm", "a"]):
        subprocess.run([*git, *step], check=True)
    guard.require_committed(str(tmp_path), ["p.json"])
    path.write_text("{}")
    with pytest.raises(guard.Refused):
        guard.require_committed(str(tmp_path), ["p.json"])


def test_tokens(spark):
    from cellgrove.functions import tokens

    vocabulary = "/opt/tokenizers/word_bpe_49k.json"
    pytest.importorskip("tokenizers")
    if not os.path.exists(vocabulary):
        pytest.skip("no vocabulary")
    d = spark.createDataFrame([(1, "  Parking   LOT "), (2, None), (3, "road " * 50)], "id int, text string")
    got = {r.id: r.ids for r in tokens.encode(d, vocabulary, context=16).collect()}
    assert all(len(v) == 16 for v in got.values()) and got[2][2:] == [0] * 14 and got[3][-1] == got[2][1]
    assert tokens.decode(got[1], vocabulary) == "parking lot"
