"""Fusion of per-class confidences into a label grid, and the rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, IDS, THRESHOLDS, Baseline, Fusion, Veto
from ..functions.scalar import f32, yes
from .grid import Grid
from .stencil import majority

EXG, HAG = F.col, F.col


def veto(name: str, v: Veto | None = None) -> Column:
    """Whether physics lets a cell be of the class: from exg, hag (NULL: unknown, never allowed) and void."""
    v = v or Veto()
    e, h = F.col("exg"), F.col("hag")
    more, less = (lambda x, t: yes(x > f32(t))), (lambda x, t: yes(x < f32(t)))
    rules = {
        "tree": more(e, v.tree_exg) | more(h, v.tree_hag),
        "grass": more(e, v.grass_exg) & less(h, v.grass_hag),
        "building": more(h, v.building_hag),
        **dict.fromkeys(("pavement", "sidewalk", "parking"), less(h, v.pavement_hag)),
        "vehicle": more(h, v.vehicle_low) & less(h, v.vehicle_high),
    }
    if name not in rules:
        raise ValueError(f"unknown class {name}")
    return rules[name] & ~F.col("void")


def tall(v: Veto) -> Column:
    return yes(F.col("hag") > f32(v.tree_hag)) & ~F.col("void")


def claims(options: Fusion, confidence: dict[str, Column] | None = None) -> dict[str, tuple[Column, Column]]:
    """For each class whether a cell claims it by confidence (by default the column of its name), and whether it keeps it."""
    out = {}
    for _, name, *_ in CLASSES:
        claim = (F.col(name) if confidence is None else confidence[name]) >= f32(THRESHOLDS[name])
        keep = claim & (veto(name, options.veto) if options.constraints else ~F.col("void"))
        if name == "tree" and options.tree_height_check:
            keep = keep & tall(options.veto)
        out[name] = (claim, keep)
    return out


def paint(kept: dict[str, Column], priority: tuple[str, ...]) -> Column:
    if sorted(priority) != sorted(IDS):
        raise ValueError("the priority must hold every class once")
    return F.coalesce(*[F.when(kept[n], F.lit(IDS[n])) for n in priority], F.lit(-1))


def painted(options: Fusion, confidence: dict[str, Column] | None = None) -> Column:
    """The label before smoothing: the first class by priority that a cell keeps, else -1."""
    return paint({n: k for n, (_, k) in claims(options, confidence).items()}, options.priority)


def revised(label: Column, before: Column, options: Fusion) -> Column:
    """A smoothed label, or the one before it where a variant takes back what physics forbids."""
    if options.physical_smoothing:
        fits = F.lit(False)
        for n, i in IDS.items():
            fits = fits | ((label == i) & veto(n, options.veto))
        label = F.when(fits, label).otherwise(before)
    if options.tree_height_check:
        label = F.when((label == IDS["tree"]) & ~tall(options.veto), before).otherwise(label)
    return label


def fuse(cells: DataFrame, grid: Grid, options: Fusion | None = None) -> DataFrame:
    """r, c, label, score from cells with exg, hag, void and one FLOAT column of confidence for each class.

    Threshold, veto, priority; then the mode filter, of which the variants take back what physics forbids; the score is
    the winner's confidence, 0 where unlabelled.
    """
    o = options or Fusion()
    d = cells.withColumn("label", painted(o)).withColumn("_pre", F.col("label"))
    if o.smoothing:
        d = majority(d, grid, o.window)
        d = d.withColumn("label", revised(F.col("label"), F.col("_pre"), o))
    score = f32(0.0)
    for n, i in IDS.items():
        score = F.when(F.col("label") == i, F.col(n)).otherwise(score)
    return d.select("r", "c", "label", f32(score).alias("score"))


def veto_stats(cells: DataFrame, options: Fusion | None = None) -> DataFrame:
    """class, claimed_px, kept_px, vetoed (share of the claims, NULL without any)."""
    cs = claims(options or Fusion())
    one = cells.agg(*[F.count_if(c).alias(f"{n}_c") for n, (c, _) in cs.items()], *[F.count_if(k).alias(f"{n}_k") for n, (_, k) in cs.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(f"{n}_c").alias("claimed_px"), F.col(f"{n}_k").alias("kept_px")) for n in cs])).alias("x")
    return one.select(rows).select("x.*").withColumn("vetoed", 1 - F.try_divide(F.col("kept_px"), F.col("claimed_px")))


def baseline(b: Baseline | None = None) -> Column:
    """The rule classifier: building, tree, grass, pavement; the first that fits, else -1."""
    b = b or Baseline()
    e, h = F.col("exg"), F.col("hag")
    hard, green = yes(e <= f32(b.hard_exg)), yes(e > f32(b.veg_exg))
    return (
        F.when(yes(h > f32(b.building_hag)) & hard, IDS["building"]).when(yes(h > f32(b.tree_hag)) & green, IDS["tree"])
        .when(yes(h < f32(b.grass_hag)) & green, IDS["grass"]).when(yes(h < f32(b.pavement_hag)) & hard, IDS["pavement"]).otherwise(-1)
    )


def proposals(label: Column) -> dict[str, Column]:
    """Rule labels as binary support for each class."""
    return {n: f32((label == i).cast("float")) for n, i in IDS.items()}


def geometry_only() -> Column:
    h = F.col("hag")
    return F.when(yes(h > f32(6.0)), IDS["tree"]).when(yes(h < f32(2.0)), IDS["grass"]).otherwise(-1)
