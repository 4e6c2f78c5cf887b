"""Transfer of grid labels to points, with the route and source of each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IDS, Transfer
from ..functions.scalar import f32, yes

# prediction_source: 0 unlabelled transfer, 1 labelled transfer, 2 below the surface, 3 no surface, 4 above it
SOURCES = (0, 1, 2, 3, 4)
ROUTES = ("transfer", "fallback", "unknown")


def _fallback(t: Transfer) -> Column:
    return F.when(yes(F.col("hag") > f32(t.below_tree)), IDS["tree"]).when(yes(F.col("exg") > f32(t.below_grass)), IDS["grass"]).otherwise(IDS["pavement"])


def _on(mode: str, band: float | None, t: Transfer) -> Column:
    """Whether a point (z) takes the label of its cell (surface_z)."""
    if mode not in ("naive", "height_aware"):
        raise ValueError("the mode must be naive or height_aware")
    width = t.surface if band is None else band
    if not (width > 0 and width < float("inf")):
        raise ValueError("the band must be finite and positive")
    return F.lit(True) if mode == "naive" else yes(F.abs(f32(f32(F.col("z")) - F.col("surface_z"))) < f32(width))


def transferred(label: Column, mode: str = "height_aware", band: float | None = None, options: Transfer | None = None) -> Column:
    """The class of a point (z, hag, exg) from its cell's label and surface_z, by the rules of `transfer`."""
    t = options or Transfer()
    return F.when(_on(mode, band, t), F.coalesce(label, F.lit(-1))).otherwise(_fallback(t)).cast("int")


def transfer(points: DataFrame, mode: str = "height_aware", band: float | None = None, options: Transfer | None = None) -> DataFrame:
    """Adds internal_class_id, model_score, prediction_source and route.

    points: z, hag, exg and their cell's label, score and surface_z (NULL where the cell has no surface). A point
    within the band of the surface takes the cell's label, in naive mode every point does; the others follow height and
    colour. The score is NULL unless the point carries a transferred label.
    """
    t = options or Transfer()
    on, delta = _on(mode, band, t), f32(f32(F.col("z")) - F.col("surface_z"))
    supported = on & (F.coalesce(F.col("label"), F.lit(-1)) >= 0)
    source = F.when(supported, 1).when(on, 0).when(F.col("surface_z").isNull(), 3).when(delta > f32(0.0), 4).otherwise(2)
    return points.withColumns(
        {
            "internal_class_id": transferred(F.col("label"), mode, band, t),
            "model_score": F.when(supported, F.col("score")),
            "prediction_source": source.cast("int"),
            "route": F.when(on, "transfer").otherwise("fallback"),
        }
    )


def transfer_legacy(points: DataFrame, options: Transfer | None = None) -> DataFrame:
    """Adds label_out and conf_out: 0..255 from the score on the surface, the rule's constant off it."""
    t = options or Transfer()
    on = yes(F.abs(f32(f32(F.col("z")) - F.col("surface_z"))) < f32(t.surface))
    conf = F.when(on, f32(F.coalesce("score", f32(0.0)) * f32(255.0)).cast("int")).otherwise(t.rule_conf)
    return points.withColumns({"label_out": F.when(on, F.coalesce("label", F.lit(-1))).otherwise(_fallback(t)).cast("int"), "conf_out": conf})


def require_transferable(points: DataFrame) -> DataFrame:
    """Checks finite heights, known labels and scores in [0, 1]."""
    bad = ~yes(F.abs(F.col("z")) < float("inf")) | ~F.coalesce("label", F.lit(-1)).isin(-1, *IDS.values()) | ~F.coalesce("score", f32(0.0)).between(0.0, 1.0)
    if not points.where(bad).limit(1).isEmpty():
        raise ValueError("heights must be finite, labels known and scores in [0, 1]")
    return points
