"""Scalar expressions: float32 rules, indices of colour and height, boxes, text and digests.

Missing values are NULL, never NaN; a comparison with a missing value is false (see `yes`). FLOAT columns are compared
with FLOAT literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASSES, CODE_NAMES, COLOUR_DIVISOR, LAS_CODES


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def exg(red: str = "red", green: str = "green", blue: str = "blue") -> Column:
    """Excess green (2G - R - B) / (R + G + B + 1e-6), every step in float32."""
    r, g, b = (f32(F.col(c)) for c in (red, green, blue))
    over = f32(f32(f32(2.0) * g - r) - b)
    under = f32(f32(f32(r + g) + b) + f32(1e-6))
    return f32(over / under)


def exg_audit(red: str = "red", green: str = "green", blue: str = "blue") -> Column:
    """The audit's excess green in double, NULL where the channels sum to 0."""
    r, g, b = (F.col(c).cast("double") for c in (red, green, blue))
    return F.try_divide(2 * g - r - b, F.when(r + g + b > 0, r + g + b))


def to_8bit(mean: Column) -> Column:
    """A mean of 16-bit colour as 0..255, truncated; missing is 0."""
    return F.least(F.greatest(F.coalesce(mean, F.lit(0.0)) / F.lit(float(COLOUR_DIVISOR)), F.lit(0.0)), F.lit(255.0)).cast("int")


def las_code(label: Column, strict: bool = False) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LAS_CODES.items() for x in pair])
    code = F.element_at(table, label) if not strict else F.coalesce(F.element_at(table, label), F.raise_error(F.concat(F.lit("unknown class id "), label.cast("string"))).cast("int"))
    return code.cast("int")


def class_name(code: Column) -> Column:
    """The display name of a LAS code: names that share one are joined by "/"."""
    names: dict[int, list[str]] = {}
    for _, n, *_, c in CLASSES:
        names.setdefault(c, []).append(n)
    out = F.lit(None).cast("string")
    for c, n in names.items():
        out = F.when(code == c, "/".join(n)).otherwise(out)
    return out


def reference_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, n in CODE_NAMES.items():
        out = F.when(code == c, n).otherwise(out)
    return out


def percent(value: Column) -> Column:
    return value * 100


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def round_half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places)


# --- boxes: arrays of four doubles


def _box(b: Column) -> list[Column]:
    return [F.get(b, i) for i in range(4)]


def cxcywh_to_xyxy(b: Column) -> Column:
    cx, cy, w, h = _box(b)
    return F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def cxcywh_to_xywh(b: Column) -> Column:
    cx, cy, w, h = _box(b)
    return F.array(cx - w / 2, cy - h / 2, w, h)


def xyxy_to_cxcywh(b: Column) -> Column:
    x0, y0, x1, y1 = _box(b)
    return F.array((x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0)


def xyxy_to_xywh(b: Column) -> Column:
    x0, y0, x1, y1 = _box(b)
    return F.array(x0, y0, x1 - x0, y1 - y0)


def xywh_to_xyxy(b: Column) -> Column:
    x, y, w, h = _box(b)
    return F.array(x, y, x + w, y + h)


def xywh_to_cxcywh(b: Column) -> Column:
    x, y, w, h = _box(b)
    return F.array(x + w / 2, y + h / 2, w, h)


def box_area(b: Column) -> Column:
    x0, y0, x1, y1 = _box(b)
    return (x1 - x0) * (y1 - y0)


def normalise_box(b: Column, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = _box(b)
    return F.array(x0 / width, y0 / height, x1 / width, y1 / height)


def box_intersection(a: Column, b: Column) -> Column:
    p, q = _box(a), _box(b)
    side = lambda i: F.greatest(F.least(p[i + 2], q[i + 2]) - F.greatest(p[i], q[i]), F.lit(0.0))
    return side(0) * side(1)


def box_union(a: Column, b: Column) -> Column:
    return box_area(a) + box_area(b) - box_intersection(a, b)


def box_iou(a: Column, b: Column) -> Column:
    return F.try_divide(box_intersection(a, b), box_union(a, b))


def box_giou(a: Column, b: Column) -> Column:
    """IoU less the share of the hull that neither box covers."""
    p, q = _box(a), _box(b)
    hull = (F.greatest(p[2], q[2]) - F.least(p[0], q[0])) * (F.greatest(p[3], q[3]) - F.least(p[1], q[1]))
    return box_iou(a, b) - F.try_divide(hull - box_union(a, b), hull)


def rectangles_overlap(a: Column, b: Column) -> Column:
    """Whether two rectangles share a positive area; touching doesn't."""
    p, q = _box(a), _box(b)
    return (F.greatest(p[0], q[0]) < F.least(p[2], q[2])) & (F.greatest(p[1], q[1]) < F.least(p[3], q[3]))


def rectangle_contains(outer: Column, inner: Column) -> Column:
    p, q = _box(outer), _box(inner)
    return (p[0] <= q[0]) & (p[1] <= q[1]) & (q[2] <= p[2]) & (q[3] <= p[3])


def detection_score(logit: Column, presence: Column) -> Column:
    return (1 / (1 + F.exp(-logit))) * (1 / (1 + F.exp(-presence)))


def perimeter_distance(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = map(F.lit, bounds)
    return F.least(x - x0, y - y0, x1 - x, y1 - y)


# --- text


def clean_lower(text: Column) -> Column:
    return F.lower(clean_whitespace(text))


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonicalise(text: Column) -> Column:
    """Lower case without ASCII punctuation (underscores are spaces), spaces collapsed."""
    plain = F.regexp_replace(F.translate(text, "_", " "), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def tile_offset(path: Column) -> tuple[Column, Column]:
    pattern = r"tile_r(\d+)_c(\d+)"
    return F.regexp_extract(path, pattern, 1).cast("int"), F.regexp_extract(path, pattern, 2).cast("int")


def suffix_code(name: Column) -> Column:
    """The LAS code that a file name's last _part names, NULL if none does."""
    part = F.lower(F.regexp_extract(name, r"_([A-Za-z]+)(?:\.\w+)?$", 1))
    out = F.lit(None).cast("int")
    for _, n, *_, c in CLASSES:
        out = F.when(part == n, c).otherwise(out)
    return out
