"""Driver queries of point files: the points of `events` written as LAS into the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import points
from .queries import BOUNDS, _sql, pts
from .sources import las, store

QUERIES: dict = {}
SQL: dict[str, str] = {}
STEP = "0.03125,0.03125,0.0625"  # the points' coordinates are multiples of it


def q(name: str, sql: str):
    def add(f):
        QUERIES[f"q_{name}"], SQL[f"q_{name}"] = f, sql
        return f

    return add


def survey(s: SparkSession, d: str) -> str:
    """All points, ascending in x from file to file, with their orig_index as the extra dimension `event`."""
    las.register(s)
    path = store.scratch(s)
    p = pts(s, d).withColumnRenamed("orig_index", "event").withColumns({"classification": F.col("classification").cast("smallint"), "return_number": F.lit(1).cast("tinyint"), "number_of_returns": F.col("number_of_returns").cast("tinyint")})
    p.repartitionByRange("x").sortWithinPartitions("x", "event").write.format("las").option("path", path).option("scale", STEP).option("records", "50000").mode("append").save()
    return path


def plain(d: DataFrame) -> DataFrame:
    return d.select(F.col("event").alias("orig_index"), "x", "y", "z", "red", "green", "blue", "intensity", F.col("number_of_returns").cast("int").alias("number_of_returns"), F.col("classification").cast("int").alias("classification"))


@q("las_roundtrip", _sql("SELECT * FROM pts"))
def _(s, d):
    return plain(s.read.format("las").load(survey(s, d)))


@q("las_zone_crop", _sql("SELECT * FROM pts WHERE x >= 20 AND x <= 90 AND y >= 30 AND y <= 100"))
def _(s, d):
    path = survey(s, d)
    las.write_zones(s, path, f"{path}-zones", run=1000)
    return plain(points.crop(s.read.format("las").option("zones", f"{path}-zones").load(path), BOUNDS))


@q("las_limited", _sql("SELECT x, count(*) AS n FROM (SELECT x FROM pts ORDER BY x LIMIT 3000) GROUP BY x"))
def _(s, d):
    d = points.limited(s.read.format("las").option("chunk", "1000").load(survey(s, d)), 3, 1000)
    return d.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@q("las_subset", _sql("SELECT orig_index, CAST(x/0.03125 AS INT) AS x_raw, CAST(y/0.03125 AS INT) AS y_raw, CAST(z/0.0625 AS INT) AS z_raw FROM pts WHERE x >= 20 AND x < 90 AND y >= 30 AND y < 100"))
def _(s, d):
    path = survey(s, d)
    las.write_subset(points.crop(s.read.format("las").load(path), BOUNDS, closed=False).drop("orig_index"), path, f"{path}-subset")
    return s.read.format("las").load(f"{path}-subset").select(F.col("event").alias("orig_index"), "x_raw", "y_raw", "z_raw")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
