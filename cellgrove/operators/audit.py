"""Data-quality and audit aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .points import running_sum


def value_histogram(points: DataFrame, channels: list[str]) -> DataFrame:
    """channel, value, n: how often each stored value occurs."""
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("value")) for c in channels])).alias("x"))
    return long.groupBy("x.channel", "x.value").agg(F.count(F.lit(1)).alias("n"))


def ranked(points: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the exact quantile, interpolated at (n - 1) share; NULL when empty.

    Equal values are counted first; the counts are added up range by range, so no task holds all the values.
    """
    counts = points.select(F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(counts, "_v", F.col("_n"), "_u").crossJoin(F.broadcast(counts.agg((F.sum("_n") - 1).alias("_last"))))  # one row
    place = {name: F.col("_last") * F.lit(q) for name, q in shares.items()}
    value_at = lambda k: F.min(F.when(F.col("_u") > k, F.col("_v")))
    ends = upto.agg(F.max("_last").alias("_last"), *[value_at(end(at)).alias(f"{name}{k}") for name, at in place.items() for k, end in enumerate((F.floor, F.ceil))])
    part = {name: at - F.floor(at) for name, at in place.items()}
    return ends.select(*[(F.col(f"{name}0") * (1 - x) + F.col(f"{name}1") * x).alias(name) for name, x in part.items()])


def quantiles(points: DataFrame, value: str) -> DataFrame:
    """One row: n, least, median, p90, p99, most, mean; NULL when empty. Exact, interpolated at (n - 1) q."""
    v = F.col(value).cast("double")
    ends = points.agg(F.count(value).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    d = ends.crossJoin(ranked(points, value, {"median": 0.5, "p90": 0.9, "p99": 0.99}))  # one row each
    return d.select("n", "least", "median", "p90", "p99", "most", "mean")


def histogram_quantiles(histogram: DataFrame) -> DataFrame:
    """The same from value counts, by channel."""
    q = lambda p: F.percentile(F.col("value").cast("double"), F.lit(p), F.col("n"))
    return histogram.groupBy("channel").agg(F.sum("n").alias("n"), F.min("value").alias("least"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("value").alias("most"))


def rgb_patterns(histogram: DataFrame) -> DataFrame:
    """By channel: distinct values, and counts of 0, 255, 65535 and of multiples of 256 and 257."""
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    v = F.col("value")
    return histogram.groupBy("channel").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"), s(v == 0).alias("zero"), s(v == 255).alias("v255"), s(v == 65535).alias("v65535"), s(v % 256 == 0).alias("by256"), s(v % 257 == 0).alias("by257"))


def rgb_endpoints(points: DataFrame) -> DataFrame:
    r, g, b = (F.col(c) for c in ("red", "green", "blue"))
    each = lambda t, how: how(how(t(r), t(g)), t(b))
    any_, all_ = (lambda a, b: a | b), (lambda a, b: a & b)
    return points.agg(F.count_if(each(lambda c: c == 0, any_)).alias("any_zero"), F.count_if(each(lambda c: c == 0, all_)).alias("all_zero"), F.count_if(each(lambda c: c == 65535, any_)).alias("any_max"), F.count_if(each(lambda c: c == 65535, all_)).alias("all_max"), F.count_if(each(lambda c: c <= 255, all_)).alias("all_le255"))


def height_stats(points: DataFrame) -> DataFrame:
    h = F.col("hag")
    return points.agg(F.count(F.lit(1)).alias("points"), F.count(h).alias("finite"), F.count_if(h < 0).alias("negative"), F.count_if(h == 0).alias("zero"), F.avg(F.when(h.isNotNull(), (h < 0).cast("double"))).alias("negative_share"))


def class_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy(F.col("classification").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def exg_histogram(points: DataFrame, bins: int = 200, low: float = -0.5, high: float = 1.0) -> DataFrame:
    """bin, n of exg in [low, high], the last bin closed."""
    x = F.col("exg").cast("double")
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return points.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def preview_stretch(cells: DataFrame, value: str = "dtm") -> DataFrame:
    """0..1 between the 2nd and 98th percentile of the values."""
    ends = ranked(cells, value, {"_a": 0.02, "_b": 0.98})
    return cells.crossJoin(F.broadcast(ends)).select("r", "c", F.least(F.greatest(F.coalesce(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("shade"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows, changed (missing equals missing), and the greatest absolute difference of what both have."""
    d = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.max(F.abs(F.col("_a") - F.col("_b"))).cast("double").alias("greatest_difference"))


def stratum_code(hag: Column, exg: Column, boundary: Column) -> Column:
    """(height bin * 3 + colour bin) * 2 + boundary: 24 strata; missing height is bin 3, missing colour bin 2."""
    h = F.when(hag.isNull(), 3).when(hag < 2, 0).when(hag <= 6, 1).otherwise(2)
    e = F.when(exg.isNull(), 2).when(exg <= 0.05, 0).otherwise(1)
    return ((h * 3 + e) * 2 + boundary.cast("int")).cast("int")
