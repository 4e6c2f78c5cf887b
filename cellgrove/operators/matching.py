"""Alignment of point sets: by id, by rounded coordinates, by tile index, and by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COORDINATE_TOLERANCE, IGNORED_CODES, REFERENCE_CODES
from ..functions.scalar import perimeter_distance, round_half_even


class AlignmentError(ValueError):
    pass


def first_of(points: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Of rows with equal keys the one with the least ordinal, by a partial aggregation instead of a sort."""
    rest = [c for c in points.columns if c not in keys]
    d = points.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_v"))
    return d.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def match_by_id(truth: DataFrame, predicted: DataFrame, key: str = "orig_index", order: str = "ordinal") -> DataFrame:
    """key, gt, pred for the ids of both sides; of duplicates the first counts."""
    t = first_of(truth.select(key, order, F.col("classification").alias("gt")), [key], order).drop(order)
    p = first_of(predicted.select(key, order, F.col("classification").alias("pred")), [key], order).drop(order)
    return t.join(p, key)


def match_by_xyz(truth: DataFrame, predicted: DataFrame, order: str = "ordinal") -> DataFrame:
    """The same with coordinates rounded half-even to two places as the key."""
    keys = {f"k{c}": round_half_even(F.col(c)) for c in "xyz"}
    side = lambda d, n: first_of(d.withColumns(keys).select(*keys, order, F.col("classification").alias(n)), [*keys], order).drop(order)
    return side(truth, "gt").join(side(predicted, "pred"), [*keys])


def match(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """By id where both sides have one, else by coordinates; without any match an error."""
    by_id = "orig_index" in truth.columns and "orig_index" in predicted.columns
    out = match_by_id(truth, predicted) if by_id else match_by_xyz(truth, predicted)
    if out.isEmpty():
        raise AlignmentError("no point matches")
    return out


def reviewed(code: str = "gt", ignored: tuple[int, ...] = IGNORED_CODES) -> Column:
    return ~F.col(code).isin(*ignored)


def align_reviewed(reference: DataFrame, predicted: DataFrame, key: str = "id", strict: bool = True) -> DataFrame:
    """All reference rows (key, ref) with `pred` and `is_reviewed`; each reviewed one must have a prediction."""
    d = reference.join(predicted.select(key, F.col("pred"), *[c for c in predicted.columns if c not in (key, "pred")], F.lit(True).alias("matched")), key, "left")
    d = d.withColumn("is_reviewed", F.col("ref").isin(*REFERENCE_CODES)).withColumn("matched", F.coalesce("matched", F.lit(False)))
    if strict:
        missing = [r[0] for r in d.where(F.col("is_reviewed") & ~F.col("matched")).select(key).limit(5).collect()]
        if missing:
            raise AlignmentError(f"reviewed points without prediction, such as {missing}")
    return d


def integrity(reference: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """One row of counters: reviewed, matched, missing, unreviewed, extra."""
    r = reference.select(key, F.col("ref").isin(*REFERENCE_CODES).alias("rv"), F.lit(1).alias("a"))
    d = r.join(predicted.select(key, F.lit(1).alias("b")), key, "full_outer")
    a, b, rv = F.col("a").isNotNull(), F.col("b").isNotNull(), F.coalesce("rv", F.lit(False))
    return d.agg(F.count_if(a).alias("reference_points"), F.count_if(b).alias("prediction_points"), F.count_if(rv).alias("expected_reviewed_points"), F.count_if(rv & b).alias("matched_reviewed_points"), F.count_if(rv & ~b).alias("missing_reviewed_points"), F.count_if(a & ~rv).alias("unreviewed_reference_points"), F.count_if(a & ~rv & ~b).alias("missing_unreviewed_points"), F.count_if(b & ~a).alias("extra_prediction_points"))


def restore(tile: DataFrame, labelled: DataFrame, key: str = "tile_index", tolerance: float = COORDINATE_TOLERANCE) -> DataFrame:
    """Labels back on their tile's points: every labelled index must exist once, at its coordinates."""
    if not labelled.groupBy(key).count().where("count > 1").isEmpty():
        raise AlignmentError("an index occurs twice")
    t = tile.select(key, *[F.col(c).alias(f"_{c}") for c in "xyz"], *[c for c in tile.columns if c not in (key, "x", "y", "z", "classification")])
    d = labelled.select(key, "x", "y", "z", "classification").join(t, key, "left")
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in "xyz"])
    if not d.where(F.coalesce(off > tolerance, F.lit(True))).limit(1).isEmpty():
        raise AlignmentError("an index is unknown or its coordinates differ")
    return d.drop("_x", "_y", "_z")


def merge_parts(tile: DataFrame, parts: dict[int, DataFrame], key: str = "orig_index", tolerance: float = COORDINATE_TOLERANCE) -> DataFrame:
    """The tile with the classes of its parts (code: rows with the key); the rest has code 1.

    An id twice in a part, in two classes, or unknown to the tile is an error, as are coordinates (of parts that have
    x, y, z) farther than the tolerance from the tile's.
    """
    union = None
    for code, d in sorted(parts.items()):
        place = [(F.col(c) if c in d.columns else F.lit(None).cast("double")).alias(f"_p{c}") for c in "xyz"]
        one = d.select(key, F.lit(code).alias("_c"), *place)
        union = one if union is None else union.unionByName(one)
    if not union.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise AlignmentError("an id stands twice in the parts")
    known = tile.withColumn("_known", F.lit(True)).join(union, key, "full_outer")
    far = F.lit(False)
    for c in [c for c in "xyz" if c in tile.columns]:
        far = far | F.coalesce(F.abs(F.col(c) - F.col(f"_p{c}")) > tolerance, F.lit(False))
    if not known.where(F.col("_known").isNull() | far).isEmpty():
        raise AlignmentError("an id is not in the tile, or lies elsewhere")
    kept = [c for c in tile.columns if c != "classification"]
    return known.where("_known").select(*kept, F.coalesce("_c", F.lit(1)).alias("classification"))


def conflicts(labelled: DataFrame, key: str = "orig_index") -> DataFrame:
    return labelled.groupBy(key).agg(F.min("classification").alias("lowest"), F.max("classification").alias("highest"), F.count_distinct("classification").alias("classes")).where("classes > 1")


def unknown_ids(points: DataFrame, tile: DataFrame, key: str = "orig_index") -> DataFrame:
    return points.join(tile, key, "left_anti")


#: Comparisons that one pair of cells may take; pairs of more points are split, down to cells of radius / 2 ** DEEPEST.
COMPARED, DEEPEST = 1 << 16, 12
_AT = ["ix", "iy", "iz"]


def _cells(place: DataFrame, radius: float, level: int) -> DataFrame:
    """place with the cell (ix, iy, iz) that each point lies in, of side radius / 2 ** level and a trifle more, so that
    rounding can't part neighbours."""
    return place.withColumns({f"i{c}": F.floor(F.col(c) / F.lit(radius * (1 + 1e-9)) * (1 << level)) for c in "xyz"})


def _boxes(placed: DataFrame, prefix: str) -> DataFrame:
    """Cells of one class each: their points' number and bounds."""
    ends = [f(c).alias(f"{prefix}{c}{k}") for c in "xyz" for f, k in ((F.min, 0), (F.max, 1))]
    named = [F.col(c).alias(f"{prefix}{c}") for c in (*_AT, "classification")]
    return placed.groupBy(*named).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *ends)


def other_class_pairs(place: DataFrame, radius: float) -> tuple[list[DataFrame], list[tuple[int, DataFrame]]]:
    """Decides places (distinct x, y, z, classification) by cells: those near another class, and what is left to compare.

    Cells are split like an octree, where they must be. Of two cells of different classes none of the points are near if
    their bounds are farther apart than the radius, and all are if no two places of the bounds are. Only pairs between
    go on: to a comparison of their points where these make COMPARED pairs at most, else to their eighths. Returns
    the decided places, by level, and (level, pairs of cells) to compare.
    """
    square = lambda parts: sum((p * p for p in parts), F.lit(0.0))
    apart = [F.greatest(F.col(f"a{c}0") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.col(f"a{c}1"), F.lit(0.0)) for c in "xyz"]
    across = [F.greatest(F.col(f"a{c}1") - F.col(f"b{c}0"), F.col(f"b{c}1") - F.col(f"a{c}0")) for c in "xyz"]
    steps = F.sequence(F.lit(-1), F.lit(1))
    placed = _cells(place, radius, 0)
    a = _boxes(placed, "a")
    for i in _AT:  # two points within the radius lie in neighbouring cells of that side
        a = a.withColumn("_s", F.explode(steps)).withColumn(f"b{i}", F.col(f"a{i}") + F.col("_s")).drop("_s")
    pairs = a.join(_boxes(placed, "b"), [f"b{i}" for i in _AT])
    decided, compared = [], []
    kept = bool(place.sparkSession.sparkContext.getCheckpointDir())
    for level in range(DEEPEST + 1):
        pairs = pairs.where((F.col("aclassification") != F.col("bclassification")) & (square(apart) <= radius * radius)).withColumn("_all", square(across) <= radius * radius)
        pairs = pairs.checkpoint() if kept else pairs.persist()
        key_a = [F.col(f"a{c}").alias(c) for c in (*_AT, "classification")]
        sure = pairs.where("_all").select(*key_a).distinct()
        decided.append(placed.join(sure, [*_AT, "classification"], "left_semi").select("x", "y", "z", "classification"))
        few = (F.col("an") * F.col("bn") <= COMPARED) | F.lit(level == DEEPEST)
        left = pairs.where("not _all").join(sure.select(*[F.col(c).alias(f"a{c}") for c in sure.columns]), [f"a{c}" for c in sure.columns], "left_anti")
        names = [f"{p}{c}" for p in "ab" for c in (*_AT, "classification")]
        compared.append((level, left.where(few).select(*names)))
        dense = left.where(~few).select(*names)
        dense = dense.checkpoint() if kept else dense.persist()
        if dense.isEmpty():
            break
        # eighths of the cells in pairs that are still dense, and the pairs of those
        both = dense.select(*key_a).unionByName(dense.select(*[F.col(f"b{c}").alias(c) for c in (*_AT, "classification")])).distinct()
        inside = placed.join(both, [*_AT, "classification"], "left_semi")
        up = {c: F.floor(F.col(c) / 2) for c in (f"{p}{i}" for p in "ab" for i in _AT)}
        placed = _cells(inside.drop(*_AT), radius, level + 1)
        parents = [dense.withColumnsRenamed({f"{p}{i}": f"{p}up{i}" for p in "ab" for i in _AT})]
        for p in "ab":
            child = _boxes(placed, p)
            child = child.withColumns({f"{p}up{i}": up[f"{p}{i}"] for i in _AT})
            parents.append(child)
        pairs = parents[0].join(parents[1], [*[f"aup{i}" for i in _AT], "aclassification"]).join(parents[2], [*[f"bup{i}" for i in _AT], "bclassification"])
    return decided, compared


def near_other_class(points: DataFrame, radius: float = 1.0, bounds: tuple[float, float, float, float] | None = None, key: str = "orig_index") -> DataFrame:
    """Reviewed points with `boundary`: within radius (3D, inclusive) of one of another class, or of the perimeter.

    Equal (place, class) pairs are one. What cells can decide is decided by cells (see other_class_pairs); the points of
    the other cells meet pair of cells by pair of cells, so a crowded place is many bounded pieces of work.
    """
    own = points.where(F.col("classification").isin(*REFERENCE_CODES))
    place = own.select("x", "y", "z", "classification").distinct()
    decided, compared = other_class_pairs(place, radius)
    near = None
    for level, pairs in compared:
        placed = _cells(place, radius, level)
        side = lambda p: placed.select(*[F.col(c).alias(f"{p}{c}") for c in (*_AT, "classification", "x", "y", "z")])  # noqa: B023, E731
        met = pairs.join(side("a"), [f"a{c}" for c in (*_AT, "classification")]).join(side("b"), [f"b{c}" for c in (*_AT, "classification")])
        square = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
        found = met.where(square <= radius * radius).select(*[F.col(f"a{c}").alias(c) for c in ("x", "y", "z", "classification")])
        near = found if near is None else near.unionByName(found)
    for d in decided:
        near = near.unionByName(d)
    near = near.distinct().withColumn("_n", F.lit(True))
    edge = F.lit(False) if bounds is None else perimeter_distance(F.col("x"), F.col("y"), bounds) <= radius
    return own.join(near, ["x", "y", "z", "classification"], "left").withColumn("boundary", F.coalesce("_n", F.lit(False)) | edge).drop("_n")


def geometry_mismatches(a: DataFrame, b: DataFrame, key: str = "orig_index", columns: tuple[str, ...] = ("x_raw", "y_raw", "z_raw"), headers: tuple | None = None) -> DataFrame:
    """One row: rows of each side, ids on one side only, and matched rows whose raw geometry differs.

    Raw integers only mean the same place under the same scale and shift: with the headers of both files, other ones
    make every matched row differ.
    """
    l = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    r = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    d = l.join(r, key, "full_outer")
    differs = F.lit(headers is not None and any(getattr(headers[0], k) != getattr(headers[1], k) for k in ("scale", "shift")))
    for c in columns:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return d.agg(F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"), F.count_if(~both).alias("unmatched"), F.count_if(both & differs).alias("differing"))
