"""Length units of coordinate systems: only the US survey foot passes, and what is merely assumed is said to be."""

from __future__ import annotations

import math

from . import wkt

# The feet in metres, how near a stated factor must come, and names of the unit that a caller may assume.
SURVEY_FOOT, INTERNATIONAL_FOOT, TOLERANCE = 1200 / 3937, 0.3048, 1e-11
ASSUMED = {"us survey foot", "us survey feet", "us survey ft", "us_survey_foot", "us-ft", "ftus"}


class UnitError(ValueError):
    pass


def is_survey_foot(metres: float) -> bool:
    return math.isclose(metres, SURVEY_FOOT, rel_tol=TOLERANCE, abs_tol=1e-12)


def _checked(a: wkt.Axis, number: int) -> dict:
    f = a.factor
    if f is None or not math.isfinite(f) or f <= 0:
        raise UnitError(f"axis {number} has no usable conversion factor to metres")
    if not is_survey_foot(f):
        kind = "the international foot" if math.isclose(f, INTERNATIONAL_FOOT, rel_tol=TOLERANCE) else "the metre" if math.isclose(f, 1.0, rel_tol=TOLERANCE) else f"a unit of {f!r} m"
        raise UnitError(f"axis {number} is in {kind}, not in US survey feet; nothing is converted")
    return {"axis": number, "name": a.name, "direction": a.direction, "declared_unit": a.unit, "metres": f}


def unit_record(text: str | None, assumed: str) -> dict:
    """What a coordinate system's text (None: there is none) tells of the units, or an error where it contradicts them.

    assumed: the unit the caller counts on, which must be stated and be the US survey foot. Without a text, or for
    heights without a vertical axis, the unit stays an assumption; the vertical datum is only what a vertical part
    names. confirm: whether the provider has still to confirm something.
    """
    if not isinstance(assumed, str) or assumed.strip().lower() not in ASSUMED:
        raise UnitError("the assumed unit must be stated, and be the US survey foot")
    record = {"assumed": assumed, "metres": SURVEY_FOOT, "rescaled": False, "crs": None, "axes": [], "horizontal": "assumed", "vertical": "assumed", "vertical_datum": None, "confirm": True}
    if text is None:
        return record
    try:
        s = wkt.system(text)
    except wkt.WktError as e:
        raise UnitError(f"the coordinate system can't be read: {e}") from e
    if s.geographic:
        raise UnitError("geographic coordinates are angles, no survey feet")
    if len(s.axes) not in (2, 3) or len(s.axes) == 1 + s.vertical:
        raise UnitError(f"two horizontal axes, and one of height at most, are expected; there are {len(s.axes)}")
    if len(s.vertical_datums) > 1:
        raise UnitError(f"several vertical datums are named: {', '.join(s.vertical_datums)}")
    datum = next(iter(s.vertical_datums), None)
    axes = [_checked(a, i + 1) for i, a in enumerate(s.axes)]
    return record | {"crs": s.title, "axes": axes, "horizontal": "declared", "vertical": "declared" if len(axes) == 3 else "assumed", "vertical_datum": datum, "confirm": len(axes) == 2 or datum is None}


def survey_units(header, assumed: str) -> dict:
    """unit_record of a LAS header; one that declares its system in another form than a text is an error, not "absent"."""
    if header.crs is None and header.other_crs:
        raise UnitError("the header declares a coordinate system by keys, which aren't read here; it isn't taken for absent")
    return unit_record(header.crs, assumed)


def require_survey_feet(text: str) -> str | None:
    """Checks that all axes are in US survey feet; the vertical datum's name, if any."""
    return unit_record(text, "US survey foot")["vertical_datum"]
