"""Point files on a store: zone maps that skip records, staged output, lost attempts."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import points
from cellgrove.sources import las, npy, store


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    """Three files of 4,000 records in strips of x, with a zone map of runs of 250."""
    las.register(spark)
    path = str(tmp_path_factory.mktemp("survey") / "las")
    rng = np.random.default_rng(4)
    rows = [(int(i * 10 + rng.integers(0, 40)), int(rng.integers(0, 1000)), int(i % 97), int(i % 7)) for i in range(12_000)]
    d = spark.createDataFrame(rows, "x_raw int, y_raw int, z_raw int, classification int").select("x_raw", "y_raw", "z_raw", F.col("classification").cast("smallint").alias("classification")).coalesce(1)
    d.write.format("las").option("path", f"file://{path}").option("scale", "0.01,0.01,0.01").option("records", "4000").mode("append").save()
    las.write_zones(spark, f"file://{path}", f"file://{path}-zones", run=250, together=4)
    return f"file://{path}", f"file://{path}-zones"


def scan(spark, survey, zones=True, **options):
    r = spark.read.format("las").option("path", survey[0]).option("chunk", "500")
    for k, v in (options | ({"zones": survey[1]} if zones else {})).items():
        r = r.option(k, v)
    return r.load()


def test_zone_map_has_every_run(spark, survey):
    z = spark.read.parquet(survey[1])
    assert z.count() == 48 and z.agg(F.sum("count")).first()[0] == 12_000 and len(las.paths_of(survey[0])) == 3
    whole = scan(spark, survey, zones=False)
    assert z.agg(F.min("x_low"), F.max("x_high"), F.min("z_low"), F.max("z_high")).first() == whole.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()


@pytest.mark.parametrize("condition, most", [("x >= 300 and x <= 320 and y < 5", 2), ("x > 399 and x < 401", 3), ("orig_index < 700", 2), ("orig_index = 4100", 1), ("orig_index in (3999, 4000)", 2), ("x = 512.34", 1), ("x < -5", 0), ("z > 2000", 0), ("x > 1190 and orig_index < 100", 0), ("orig_index >= 11900 and x > 0", 1)])
def test_filters_read_only_what_can_match(spark, survey, condition, most):
    """A zone has 250 records, a partition at most 500: at most so many partitions, and the rows of a whole scan."""
    d, whole = scan(spark, survey).where(condition), scan(spark, survey, zones=False)
    assert d.rdd.getNumPartitions() <= max(most, 1) and whole.rdd.getNumPartitions() == 24
    plain = whole.select("*").cache()
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, plain.where(condition).collect()))
    plain.unpersist()


def test_limited_and_crop_use_the_map(spark, survey):
    d = points.limited(scan(spark, survey), 2, 500)
    assert d.rdd.getNumPartitions() == 2 and d.count() == 1000
    without = points.limited(scan(spark, survey, zones=False), 2, 500)
    assert without.rdd.getNumPartitions() == 2 and without.count() == 1000
    d = points.crop(scan(spark, survey), (100.0, 0.0, 110.0, 20.0))
    assert d.rdd.getNumPartitions() <= 3 and d.count() == points.crop(scan(spark, survey, zones=False), (100.0, 0.0, 110.0, 20.0)).count() > 0


def test_a_map_of_other_files_is_refused(spark, survey, tmp_path):
    other = f"file://{tmp_path}/las"
    scan(spark, survey, zones=False).drop("orig_index").limit(100).coalesce(1).write.format("las").option("path", other).mode("append").save()
    with pytest.raises(Exception, match="zone map"):
        spark.read.format("las").option("path", other).option("zones", survey[1]).load().where("x > 1").count()


def test_las_empty_and_again(spark, tmp_path):
    las.register(spark)
    path = f"file://{tmp_path}/none"
    d = spark.createDataFrame([], "x double, y double, z double")
    d.write.format("las").option("path", path).mode("append").save()
    assert spark.read.format("las").load(path).count() == 0 and len(store.files(path, ".las")) == 1
    with pytest.raises(Exception, match="not empty"):
        d.write.format("las").option("path", path).mode("append").save()


def test_staged_files_of_lost_attempts_go(tmp_path):
    target = f"file://{tmp_path}/out"
    s = store.Staging.begin(target)
    s.write([b"lost"], 0, ".bin")
    kept = s.write([b"a", b"b"], 0, ".bin")
    s.commit([(kept, "part.bin")])
    assert os.listdir(tmp_path / "out") == ["part.bin"] and store.read(f"{target}/part.bin") == b"ab" and store.read(f"{target}/part.bin", 1, 1) == b"b"
    with pytest.raises(FileExistsError):
        store.Staging.begin(target)
    store.replace(f"{target}/part.bin", b"new")
    assert store.files(target, ".bin") == [store.resolve(target)[1] + "/part.bin"] and store.read(f"{target}/part.bin") == b"new"


def test_a_task_that_dies_is_written_once(tmp_path):
    """In a session of its own: each partition's first attempt ends with its Python process."""
    code = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from cellgrove.sources import las
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        las.register(spark)

        def dies(batches):
            from pyspark import TaskContext
            t = TaskContext.get()
            for k, b in enumerate(batches):
                yield b
                if t.attemptNumber() == 0 and k == 1:
                    os._exit(1)

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        d = spark.range(0, 1000, 1, 2).select(F.col("id").cast("int").alias("x_raw"), F.lit(0).alias("y_raw"), F.lit(0).alias("z_raw"))
        d.mapInArrow(dies, d.schema).write.format("las").option("path", "file://{tmp_path}/las").option("records", "150").mode("append").save()
        got = spark.read.format("las").load("file://{tmp_path}/las")
        print("ROWS", got.count(), got.select("x_raw").distinct().count())
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=180)
    assert "ROWS 1000 1000" in done.stdout, done.stderr[-2000:]
    assert all(n.startswith("part-") for n in os.listdir(tmp_path / "las"))


def test_npz_bundles(spark, tmp_path):
    """Stored and compressed bundles, read by ranges or as a stream; written from npy files."""
    a, b = np.arange(24, dtype="f4").reshape(4, 6) / 8, np.arange(5, dtype="u1")
    np.savez(tmp_path / "stored.npz", a=a, b=b)
    np.savez_compressed(tmp_path / "small.npz", a=a, b=b, none=np.zeros(0, "i4"))
    for name in ("stored", "small"):
        path = f"file://{tmp_path}/{name}.npz"
        assert npy.npz_shapes(path)["a"] == (4, 6)
        for k, x in (("a", a), ("b", b)):
            got = npy.read_npz(spark, path, k, rows=5)
            assert [r.value for r in got.orderBy("position").collect()] == x.ravel().tolist()
    assert npy.read_npz(spark, f"file://{tmp_path}/stored.npz", "a", rows=5).rdd.getNumPartitions() == 5
    assert npy.read_npz(spark, f"file://{tmp_path}/small.npz", "none").count() == 0
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    out = f"file://{tmp_path}/made.npz"
    npy.write_npz(out, {"a": f"file://{tmp_path}/a.npy", "b": str(tmp_path / "b.npy")}, block=16)
    with np.load(tmp_path / "made.npz") as z:
        assert (z["a"] == a).all() and (z["b"] == b).all()
    assert [r.value for r in npy.read_npz(spark, out, "b", rows=2).orderBy("position").collect()] == b.tolist()
    with pytest.raises(FileExistsError):
        npy.write_npz(out, {})
