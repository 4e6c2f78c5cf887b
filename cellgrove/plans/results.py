"""Result tables of a study, all from one grouped count: overall, strata and routes of every method."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CODE_NAMES, REFERENCE_CODES
from ..operators import metrics
from ..sources import sinks
from .experiments import Configuration

BY = ["method", "group", "subset"]


def counted(scored: DataFrame, masks: list[str], route: str = "route") -> DataFrame:
    """method, group, subset, reference, prediction, count of reviewed rows (method, ref, pred, boolean masks, route).

    Rows are counted by all of these at once, so that only counts, not rows, are repeated for the overlapping masks.
    Null masks are false; rows without a route are in no route.
    """
    d = scored.where(F.col("ref").isin(*REFERENCE_CODES)).withColumns({"prediction": metrics.outcome("pred"), **{m: F.coalesce(F.col(m), F.lit(False)) for m in masks}})
    once = d.groupBy("method", F.col("ref").alias("reference"), "prediction", *masks, F.col(route).alias("route")).agg(F.count(F.lit(1)).alias("n"))
    name = lambda g, s: F.struct(F.lit(g).alias("group"), s.alias("subset"))
    groups = [name("overall", F.lit("all")), *[F.when(F.col(m), name("strata", F.lit(m))) for m in masks], F.when(F.col("route").isNotNull(), name("routes", F.col("route")))]
    each = once.select("method", "reference", "prediction", "n", F.explode(F.array_compact(F.array(*groups))).alias("g"))
    return each.groupBy("method", "g.group", "g.subset", "reference", "prediction").agg(F.sum("n").alias("count"))


def _percent(c: str, out: str) -> Column:
    return (F.col(c) * 100).alias(f"{out}_percent")


def confusion(counts: DataFrame) -> DataFrame:
    """Every reference and outcome of every subset, zeros too."""
    spark = counts.sparkSession
    codes = spark.range(1).select(F.explode(F.array(*map(F.lit, REFERENCE_CODES))).alias("reference"))
    outcomes = spark.range(1).select(F.explode(F.array(*map(F.lit, metrics.OUTCOMES))).alias("prediction"))
    every = counts.select(*BY).distinct().crossJoin(F.broadcast(codes)).crossJoin(F.broadcast(outcomes))  # 5 x 7 for each subset
    return every.join(counts, [*BY, "reference", "prediction"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def tables(counts: DataFrame, scores: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The six tables by name. scores: the kind of score of each method's proposals, where there is any.

    Undefined rates are NULL; share is of the method's reviewed points.
    """
    classes = metrics.per_class(counts, BY)
    s = metrics.summary(classes, BY)
    shown = ["primary_loss", "overall_accuracy", "macro_iou"]
    figures = [F.col("scored_points").alias("points"), F.col("error_points").alias("errors"), *[_percent(c, o) for c, o in zip(shown, ("balanced_error", "accuracy", "mean_iou"))], F.col("unlabelled_points").alias("unlabelled"), F.col("invalid_points").alias("invalid")]
    iou = classes.where("group = 'overall'").groupBy("method").agg(*[F.max(F.when(F.col("code") == c, F.col("iou") * 100)).alias(f"{n}_iou_percent") for c, n in CODE_NAMES.items()])
    kind = F.element_at(F.create_map(*[F.lit(x) for p in scores.items() for x in p]), F.col("method")) if scores else F.lit(None).cast("string")
    whole = s.where("group = 'overall'")
    totals = whole.select("method", F.col("scored_points").alias("_all"))
    tidy = classes.select(*BY, F.col("code").alias("reference"), "class_name", "present", "support", "true_positive", "false_positive", "false_negative", *[_percent(c, c) for c in ("precision", "recall", "f1", "iou")])
    dense = confusion(counts)
    parts, overall = F.col("group") != "overall", F.col("group") == "overall"
    return {
        "all_methods": whole.select("method", *figures, _percent("label_coverage", "coverage"), kind.alias("proposal_score_kind")).join(iou, "method"),
        "confusion_matrices": dense.where(overall),
        "per_class_metrics": tidy.where(overall),
        "strata_and_routes": s.where(parts).join(totals, "method").select(*BY, *figures, (F.try_divide(F.col("scored_points") * 100.0, F.col("_all"))).alias("share_percent")),
        "strata_and_routes_confusion_matrices": dense.where(parts),
        "strata_and_routes_per_class_metrics": tidy.where(parts),
    }


def source_effect(all_methods: DataFrame, chosen: list[Configuration], a: str = "rules", b: str = "neural") -> DataFrame:
    """Errors and losses of two sources under the same switches, and the difference in percentage points."""
    named = [(c.name, c.source, c.fusion.constraints, c.fusion.smoothing, c.mode) for c in chosen if c.source and c.name == f"{c.source}_c{c.fusion.constraints:d}_s{c.fusion.smoothing:d}_{c.mode}"]
    keys = all_methods.sparkSession.createDataFrame(named, "method string, source string, constraints boolean, smoothing boolean, transfer string")
    d = all_methods.join(F.broadcast(keys), "method")  # sixteen names
    switches = ["constraints", "smoothing", "transfer"]
    side = lambda s: d.where(F.col("source") == s).select(*switches, F.col("errors").alias(f"{s}_errors"), F.col("balanced_error_percent").alias(f"{s}_loss_percent"))
    return side(a).join(side(b), switches).withColumn(f"{b}_minus_{a}_pp", F.col(f"{b}_loss_percent") - F.col(f"{a}_loss_percent"))


def before_and_after(old: DataFrame, new: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Earlier results beside new ones (tables like all_methods), by pairs of names; a pair without both sides is left out."""
    names = new.sparkSession.createDataFrame(list(pairs.items()), "method string, new_method string")
    kept = ["errors", "balanced_error_percent", "accuracy_percent", "mean_iou_percent", "unlabelled"]
    side = lambda d, p, key: d.select(F.col("method").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in kept])
    d = F.broadcast(names).join(side(old, "old", "method"), "method").join(side(new, "new", "new_method"), "new_method")
    return d.withColumn("delta_errors", F.col("new_errors") - F.col("old_errors"))


def write(found: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table as CSV with a header in a new folder of its name; the rows of each."""
    rows = {}
    for name, d in found.items():
        sinks.write_csv(d.coalesce(1), f"{folder}/{name}")
        rows[name] = d.count()
    return rows


def document(found: dict[str, DataFrame]) -> str:
    """The overall tables as strict JSON: a few rows a method."""
    return json.dumps({n: [r.asDict() for r in found[n].collect()] for n in ("all_methods", "confusion_matrices", "per_class_metrics")}, allow_nan=False, sort_keys=True)
