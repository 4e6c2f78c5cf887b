"""Scores: confusion counts and what follows from them, as tidy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, CODE_NAMES, LAS_CODES, REFERENCE_CODES, UNLABELLED_CODE

OUTCOMES = (*map(str, REFERENCE_CODES), "unlabelled", "invalid")


def confusion(matched: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """gt, pred, count over the square of configured, unlabelled and observed codes; empty pairs are 0."""
    spark = matched.sparkSession
    pairs = matched.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("count"))
    config = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted({*LAS_CODES.values(), UNLABELLED_CODE})))).alias("code"))
    codes = config.union(pairs.select(F.col("gt").alias("code"))).union(pairs.select(F.col("pred").alias("code"))).distinct()
    square = codes.select(F.col("code").alias("gt")).crossJoin(codes.select(F.col("code").alias("pred")))  # class codes only
    return square.join(pairs, ["gt", "pred"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def iou(counts: DataFrame) -> DataFrame:
    """code, tp, denominator, iou (NULL for a code that occurs on neither side)."""
    both = counts.select(F.col("gt").alias("code"), "count", F.when(F.col("gt") == F.col("pred"), F.col("count")).otherwise(0).alias("tp")).unionByName(counts.where("gt <> pred").select(F.col("pred").alias("code"), "count", F.lit(0).cast("long").alias("tp")))
    return both.groupBy("code").agg(F.sum("tp").alias("tp"), F.sum("count").alias("denominator")).withColumn("iou", F.try_divide(F.col("tp").cast("double"), F.col("denominator")))


def outcome(pred: str = "pred") -> Column:
    """A prediction as one of OUTCOMES."""
    p = F.col(pred)
    return F.when(p.isin(*REFERENCE_CODES), p.cast("string")).when(p == UNLABELLED_CODE, "unlabelled").otherwise("invalid")


def confusion_strict(scored: DataFrame, ref: str = "ref", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Counts of the reviewed rows: by..., reference, prediction (an outcome), count."""
    d = scored.where(F.col(ref).isin(*REFERENCE_CODES)).withColumn("prediction", outcome(pred))
    return d.groupBy(*(by or []), F.col(ref).alias("reference"), "prediction").agg(F.count(F.lit(1)).alias("count"))


def _codes(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, REFERENCE_CODES))).alias("code"))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., code, class_name, present, support, tp, fp, fn, loss, precision, recall, f1, iou, unlabelled, invalid.

    Ratios of a class without reference are NULL; its counts stay.
    """
    by = by or []
    n, ref, pred = F.col("count"), F.col("reference").cast("string"), F.col("prediction")
    hit = ref == pred
    as_ref = counts.groupBy(*by, F.col("reference").alias("code")).agg(F.sum(n).alias("support"), F.sum(F.when(hit, n).otherwise(0)).alias("true_positive"), F.sum(F.when(pred == "unlabelled", n).otherwise(0)).alias("unlabelled_count"), F.sum(F.when(pred == "invalid", n).otherwise(0)).alias("invalid_count"))
    as_pred = counts.where(pred.rlike("^[0-9]+$")).groupBy(*by, pred.cast("int").alias("code")).agg(F.sum(F.when(~hit, n).otherwise(0)).alias("false_positive"))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    d = groups.crossJoin(_codes(counts.sparkSession))  # five codes for each group
    d = d.join(as_ref, [*by, "code"], "left").join(as_pred, [*by, "code"], "left").fillna(0, ["support", "true_positive", "unlabelled_count", "invalid_count", "false_positive"])
    name = F.element_at(F.create_map(*[F.lit(x) for p in CODE_NAMES.items() for x in p]), F.col("code"))
    tp, fp, s = F.col("true_positive"), F.col("false_positive"), F.col("support")
    fn = s - tp
    there = lambda a, b: F.when(s > 0, F.try_divide(a.cast("double"), b))
    return d.select(*by, "code", name.alias("class_name"), (s > 0).alias("present"), "support", (tp + fp).alias("predicted_count"), "true_positive", "false_positive", fn.alias("false_negative"), there(fn, s).alias("error_loss"), there(tp, tp + fp).alias("precision"), there(tp, s).alias("recall"), there(2 * tp, 2 * tp + fp + fn).alias("f1"), there(tp, tp + fp + fn).alias("iou"), "unlabelled_count", "invalid_count")


def summary(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each group): counts, rates, class-balanced loss over the present classes, accuracy, macro IoU."""
    s = F.sum
    d = classes.groupBy(*(by or [])).agg(s("support").alias("scored_points"), s("true_positive").alias("correct_points"), s("unlabelled_count").alias("unlabelled_points"), s("invalid_count").alias("invalid_points"), F.avg("error_loss").alias("primary_loss"), F.avg("iou").alias("macro_iou"))
    n = F.col("scored_points")
    rate = lambda x: F.try_divide(x.cast("double"), n)
    bad = F.col("unlabelled_points") + F.col("invalid_points")
    return d.withColumns({"error_points": n - F.col("correct_points"), "wrong_label_points": n - F.col("correct_points") - bad, "unlabelled_rate": rate(F.col("unlabelled_points")), "invalid_rate": rate(F.col("invalid_points")), "label_coverage": rate(n - bad), "balanced_accuracy": 1 - F.col("primary_loss"), "overall_accuracy": rate(F.col("correct_points"))})


def score(scored: DataFrame, by: list[str] | None = None, ref: str = "ref", pred: str = "pred") -> DataFrame:
    return summary(per_class(confusion_strict(scored, ref, pred, by), by), by)


def strata_scores(scored: DataFrame, masks: list[str]) -> DataFrame:
    """Scores of overlapping boolean masks, each with its share of the reviewed rows; empty ones stay, with NULL scores."""
    d = scored.where(F.col("ref").isin(*REFERENCE_CODES))
    long = d.select("ref", "pred", F.explode(F.array(*[F.when(F.col(m), F.lit(m)) for m in masks])).alias("stratum")).where("stratum is not null")
    names = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, masks))).alias("stratum"))
    total = d.agg(F.count(F.lit(1)).alias("_all"))
    return names.join(score(long, ["stratum"]), "stratum", "left").crossJoin(total).withColumn("scored_points", F.coalesce("scored_points", F.lit(0))).withColumn("share_of_reviewed_points", F.try_divide(F.col("scored_points").cast("double"), F.col("_all"))).drop("_all")


def route_scores(scored: DataFrame, predicted: DataFrame, routes: tuple[str, ...] = ("transfer", "fallback", "unknown")) -> DataFrame:
    """Scores by route, with shares of the reviewed rows and of all predictions; every route has a row."""
    d = scored.where(F.col("ref").isin(*REFERENCE_CODES))
    names = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, routes))).alias("route"))
    every = predicted.groupBy("route").agg(F.count(F.lit(1)).alias("all_prediction_points"))
    totals = d.agg(F.count(F.lit(1)).alias("_r")).crossJoin(predicted.agg(F.count(F.lit(1)).alias("_p")))
    out = names.join(score(d, ["route"]), "route", "left").join(every, "route", "left").crossJoin(totals).fillna(0, ["scored_points", "all_prediction_points"])
    return out.withColumns({"share_of_reviewed_points": F.try_divide(F.col("scored_points").cast("double"), F.col("_r")), "share_of_all_predictions": F.try_divide(F.col("all_prediction_points").cast("double"), F.col("_p"))}).drop("_r", "_p")


def region_mean(scores: DataFrame, region: str = "region") -> DataFrame:
    """The mean of the regions' losses, each region with equal weight."""
    return scores.agg(F.count(region).alias("regions"), F.avg("primary_loss").alias("macro_loss"))


def class_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share for every class id and -1."""
    ids = labels.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, [-1, *(i for i, *_ in CLASSES)]))).alias("label"))
    n = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = labels.agg(F.count(F.lit(1)).alias("_all"))
    return ids.join(n, "label", "left").crossJoin(total).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("_all")).alias("share"))


def same_support(classes: DataFrame, method: str = "method") -> bool:
    """Whether all methods were scored on the same reference counts."""
    per = classes.groupBy(method).agg(F.array_sort(F.collect_list(F.struct("code", "support"))).alias("s"))
    return per.agg(F.count_distinct("s")).first()[0] <= 1


def select_best(candidates: DataFrame, tie: float = 1e-12) -> DataFrame:
    """The least loss; of losses within `tie` the fewest learned parts, then stages, then time, then the name.

    candidates: name, loss, learned, stages, seconds (and complete, if any).
    """
    if "complete" in candidates.columns and not candidates.where("not complete or loss is null").isEmpty():
        raise ValueError("a candidate is incomplete")
    best = candidates.agg(F.min("loss").alias("_b"))
    return candidates.crossJoin(best).where(F.abs(F.col("loss") - F.col("_b")) <= tie).orderBy("learned", "stages", "seconds", "name").limit(1).drop("_b")


def paired_contrast(results: DataFrame, a: str = "rules", b: str = "neural", switches: tuple[str, ...] = ("constraints", "smoothing", "transfer")) -> DataFrame:
    """The losses of two sources under the same switches, and their difference."""
    side = lambda s: results.where(F.col("source") == s).select(*switches, F.col("loss").alias(f"{s}_loss"))
    return side(a).join(side(b), list(switches)).withColumn("difference", F.col(f"{b}_loss") - F.col(f"{a}_loss"))


def named_pairs(results: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Results joined through a table of (earlier name, later name)."""
    m = results.sparkSession.createDataFrame(list(pairs.items()), "old string, new string")
    side = lambda n: results.select(F.col("name").alias(n), F.col("loss").alias(f"{n}_loss"))
    return m.join(side("old"), "old").join(side("new"), "new").withColumn("difference", F.col("new_loss") - F.col("old_loss"))


def tidy_confusion(counts: DataFrame, method: str, group: str, subset: str) -> DataFrame:
    return counts.select(F.lit(method).alias("method"), F.lit(group).alias("group"), F.lit(subset).alias("subset"), "reference", "prediction", "count")


def tidy_per_class(classes: DataFrame, method: str, group: str, subset: str) -> DataFrame:
    p = lambda c: (F.col(c) * 100).alias(f"{c}_percent")
    return classes.select(F.lit(method).alias("method"), F.lit(group).alias("group"), F.lit(subset).alias("subset"), F.col("code").alias("reference"), "class_name", "present", "support", "true_positive", "false_positive", "false_negative", p("precision"), p("recall"), p("f1"), p("iou"))


def recounted(scored: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """code, support, true_positive, false_positive, false_negative, counted from the rows themselves, by no confusion."""
    r, p, codes = F.col(ref), F.col(pred), REFERENCE_CODES
    known = r.isin(*codes)
    of = lambda c: F.struct(F.lit(c).alias("code"), F.count_if(r == c).alias("support"), F.count_if((r == c) & F.coalesce(p == c, F.lit(False))).alias("true_positive"), F.count_if(known & (r != c) & (p == c)).alias("false_positive"), F.count_if((r == c) & ~F.coalesce(p == c, F.lit(False))).alias("false_negative"))
    return scored.agg(F.array(*map(of, codes)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def disagreements(classes: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows of per_class whose counts are not those of `recounted`; none if the metrics hold."""
    names = ["code", "support", "true_positive", "false_positive", "false_negative"]
    return classes.select(*names).exceptAll(counted.select(*names)).unionByName(counted.select(*names).exceptAll(classes.select(*names)))
