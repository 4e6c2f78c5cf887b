"""The component study: configurations, one prediction for each, tidy scores."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IDS, REFERENCE_CODES, Fusion
from ..functions.scalar import las_code
from ..operators import fusion, metrics, transfer
from ..operators.grid import Grid
from ..operators.points import Bounds, crop
from ..operators.stencil import modes


@dataclass(frozen=True)
class Configuration:
    name: str
    source: str | None = None
    pointwise: str | None = None
    mode: str = "height_aware"
    band: float | None = None
    box_fraction: float | None = None
    fusion: Fusion = Fusion()

    @property
    def learned(self) -> int:
        return int(self.source == "neural")

    @property
    def stages(self) -> int:
        return 1 if self.pointwise else 3 + self.fusion.constraints + self.fusion.smoothing + (self.mode == "height_aware")


def configurations() -> list[Configuration]:
    """Two pointwise rules, sixteen combinations of source and switches, ten variants of the anchor: 28."""
    out = [Configuration("geometry_only", pointwise="geometry"), Configuration("point_rules", pointwise="rules")]
    for source, c, s, mode in itertools.product(("rules", "neural"), (False, True), (False, True), ("naive", "height_aware")):
        out.append(Configuration(f"{source}_c{c:d}_s{s:d}_{mode}", source, mode=mode, fusion=Fusion(constraints=c, smoothing=s)))
    anchor = Configuration("anchor", "neural")
    switch = lambda name, **k: replace(anchor, name=name, fusion=Fusion(**k))
    out += [switch("tree_height", tree_height_check=True), switch("physical_smoothing", physical_smoothing=True), switch("both", tree_height_check=True, physical_smoothing=True)]
    out += [replace(anchor, name=f"transfer_band_{b:g}", band=b) for b in (1.5, 6.0)]
    out += [switch(f"majority_{w}", window=w) for w in (1, 3, 9)]
    return out + [replace(anchor, name=f"bbox_{b:g}", box_fraction=b) for b in (0.5, 1.0)]


def title(c: Configuration) -> str:
    """A configuration in words."""
    if c.pointwise:
        return f"{c.pointwise} rules for each point"
    f = c.fusion
    parts = [f"{c.source} proposals", "constraints" if f.constraints else "no constraints", f"mode filter {f.window}" if f.smoothing else "no smoothing", f"{c.mode.replace('_', ' ')} transfer"]
    parts += [t for t, on in (("tree height check", f.tree_height_check), ("physical smoothing", f.physical_smoothing), (f"band {c.band}", c.band is not None), (f"boxes up to {c.box_fraction}", c.box_fraction is not None)) if on]
    return ", ".join(parts)


def _source(c: Configuration) -> str:
    return c.source if c.box_fraction is None else f"{c.source}_{c.box_fraction:g}"


def predict(c: Configuration, points: DataFrame, grid: Grid, cells: dict[str, DataFrame]) -> DataFrame:
    """Points (with r, c, z, hag, exg) labelled by one configuration; cells: stat cells with confidences by source."""
    if c.pointwise:
        label = fusion.geometry_only() if c.pointwise == "geometry" else fusion.baseline()
        d = points.withColumns({"internal_class_id": label, "route": F.lit("unknown")})
    else:
        given = cells[_source(c)]
        view = fusion.fuse(given, grid, c.fusion).join(given.select("r", "c", "surface_z"), ["r", "c"])
        d = transfer.transfer(grid.gather(points, view), c.mode, c.band)
    return d.withColumn("pred", las_code(F.col("internal_class_id")))


def context(points: DataFrame, grid: Grid, cells: DataFrame, bounds: Bounds, closed: bool = False) -> DataFrame:
    """The points of a rectangle (half open unless closed) with their cell (r, c) and what `cells` holds for it."""
    return grid.gather(grid.with_index(crop(points, bounds, closed)), cells)


Sources = dict[str, dict[str, Column]]


def side_by_side(cells: dict[str, DataFrame]) -> tuple[DataFrame, Sources]:
    """Stat cells with confidences, kept apart by source, as one frame, and where each source's classes are in it."""
    wide, given = None, {}
    for k, (source, d) in enumerate(cells.items()):
        given[source] = {n: F.col(f"_s{k}_{n}") for n in IDS}
        named = [F.col(n).alias(f"_s{k}_{n}") for n in IDS]
        wide = d.select("r", "c", "exg", "hag", "void", "surface_z", *named) if wide is None else wide.join(d.select("r", "c", *named), ["r", "c"])
    return wide, given


def labelled_cells(grid: Grid, wide: DataFrame, given: Sources, chosen: list[Configuration]) -> tuple[DataFrame, dict[tuple[str, Fusion], str]]:
    """r, c, surface_z and one label column for each distinct (source, fusion) of the configurations, in one plan.

    wide: stat cells, given: the confidences of each source from their columns. Labels before smoothing are shared, and
    the votes of all windows come from one set of running sums.
    """
    fused = list(dict.fromkeys((_source(c), c.fusion) for c in chosen if not c.pointwise))
    before = lambda source, f: (source, f.constraints, f.tree_height_check, f.veto, f.priority)
    names: dict = {}
    sizes: dict[str, set[int]] = {}
    for source, f in fused:
        name = names.setdefault(before(source, f), f"_p{len(names)}")
        if name not in sizes:
            wide, sizes[name] = wide.withColumn(name, fusion.painted(f, given[source])), set()
        sizes[name] |= {f.window} if f.smoothing else set()
    voted, found = modes(wide, grid, {n: (F.col(n), tuple(sorted(s))) for n, s in sizes.items() if s})
    voted = voted.withColumns({f"{n}_m{s}": c for (n, s), c in found.items()})
    out = {}
    for k, (source, f) in enumerate(fused):
        pre = names[before(source, f)]
        label = fusion.revised(F.col(f"{pre}_m{f.window}"), F.col(pre), f) if f.smoothing else F.col(pre)
        out[source, f] = (f"_l{k}", label.cast("tinyint").alias(f"_l{k}"))
    return voted.select("r", "c", "surface_z", *[c for _, c in out.values()]), {k: n for k, (n, _) in out.items()}


def matrix(points: DataFrame, grid: Grid, cells: dict[str, DataFrame] | tuple[DataFrame, Sources], chosen: list[Configuration] | None = None) -> DataFrame:
    """method, reference, prediction, count of every configuration, in one pass over the points (with r, c and `ref`).

    cells: stat cells with confidences by source, or one frame and where the sources are in it. Each point gets the codes of all configurations at once; equal
    tuples of reference and codes are counted before they are taken apart, so no point is repeated for each method.
    """
    chosen = chosen or configurations()
    d = points.where(F.col("ref").isin(*REFERENCE_CODES)).select("r", "c", "z", "hag", "exg", "ref")
    if any(not c.pointwise for c in chosen):
        used = {_source(c): None for c in chosen if not c.pointwise}
        wide, given = side_by_side({n: cells[n] for n in used}) if isinstance(cells, dict) else cells
        view, labels = labelled_cells(grid, wide, given, chosen)
        d = grid.gather(d, view)

    def code(c: Configuration):
        if c.pointwise:
            return las_code(fusion.geometry_only() if c.pointwise == "geometry" else fusion.baseline())
        return las_code(transfer.transferred(F.col(labels[_source(c), c.fusion]), c.mode, c.band))

    tuples = d.groupBy("ref", F.array(*[code(c) for c in chosen]).alias("preds")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c.name) for c in chosen])
    each = tuples.select("ref", "n", F.posexplode("preds").alias("k", "pred")).select(F.get(names, F.col("k")).alias("method"), F.col("ref").alias("reference"), metrics.outcome("pred").alias("prediction"), "n")
    return each.groupBy("reference", "prediction", "method").agg(F.sum("n").alias("count"))


def select_final(counts: DataFrame, chosen: list[Configuration], seconds: dict[str, float]) -> DataFrame:
    scores = metrics.summary(metrics.per_class(counts, ["method"]), ["method"])
    cost = counts.sparkSession.createDataFrame([(c.name, c.learned, int(c.stages), float(seconds.get(c.name, 0.0))) for c in chosen], "name string, learned int, stages int, seconds double")
    return metrics.select_best(scores.select(F.col("method").alias("name"), F.col("primary_loss").alias("loss")).join(cost, "name"))
