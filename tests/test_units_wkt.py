"""Coordinate-system texts: trees, axes, units and datums; what contradicts survey feet is refused."""

import struct

import pytest

from cellgrove.functions import units, wkt
from cellgrove.sources import las

FOOT = "0.304800609601219"
PROJ = f'PROJCS["Test zone",GEOGCS["geo",DATUM["D",SPHEROID["S",6378137,298.25]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert"],PARAMETER["false_easting",300000],UNIT["US survey foot",{FOOT}],AXIS["X",EAST],AXIS["Y",NORTH]]'
VERT = f'VERT_CS["height",VERT_DATUM["North American Vertical Datum 1988",2005],UNIT["US survey foot",{FOOT}],AXIS["Up",UP]]'
PROJ2 = f'PROJCRS["Two",BASEGEOGCRS["g",DATUM["d",ELLIPSOID["e",1,2,LENGTHUNIT["metre",1]]]],CONVERSION["c",METHOD["m"],PARAMETER["p",1,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["easting (X)",east,ORDER[1],LENGTHUNIT["US survey foot",{FOOT}]],AXIS["northing (Y)",north,ORDER[2],LENGTHUNIT["US survey foot",{FOOT}]]]'
VERT2 = f'VERTCRS["h",VDATUM["Datum ""two"""],CS[vertical,1],AXIS["height",up],LENGTHUNIT["US survey foot",{FOOT}]]'


def record(text, assumed="US survey foot"):
    return units.unit_record(text, assumed)


def test_trees():
    n = wkt.parse('A["x ""y""", 1.5e-3, east, B(2, C[])]')
    assert n.name == "A" and n.title == 'x "y"' and n.parts[1] == 0.0015 and n.parts[2] == wkt.Node("EAST") and n.parts[3].parts == (2.0, wkt.Node("C"))
    for bad in ("", "A[", "A]", 'A["x]', "A[1]B[2]", "[1]", "A[1]]", '"x"', "A[?]"):
        with pytest.raises(wkt.WktError):
            wkt.parse(bad)


def test_absent_system_is_an_assumption():
    r = record(None)
    assert r["horizontal"] == r["vertical"] == "assumed" and r["vertical_datum"] is None and r["confirm"] and r["metres"] == 1200 / 3937 and not r["rescaled"]


@pytest.mark.parametrize("text", [PROJ, PROJ2])
def test_two_axes_say_nothing_of_heights(text):
    r = record(text, "us-ft")
    assert r["horizontal"] == "declared" and r["vertical"] == "assumed" and r["vertical_datum"] is None and r["confirm"] and len(r["axes"]) == 2


@pytest.mark.parametrize("text, datum", [(f'COMPD_CS["c",{PROJ},{VERT}]', "North American Vertical Datum 1988"), (f'COMPOUNDCRS["c",{PROJ2},{VERT2}]', 'Datum "two"'), (f'BOUNDCRS[SOURCECRS[COMPOUNDCRS["c",{PROJ2},{VERT2}]],TARGETCRS[GEOGCRS["w"]]]', 'Datum "two"')])
def test_compound_systems(text, datum):
    r = record(text)
    assert r["vertical"] == "declared" and r["vertical_datum"] == datum and not r["confirm"] and [a["direction"] for a in r["axes"]] == ["east", "north", "up"]
    assert units.require_survey_feet(text) == datum


@pytest.mark.parametrize(
    "text, said",
    [
        (PROJ.replace(f'UNIT["US survey foot",{FOOT}]', 'UNIT["metre",1]'), "metre"),
        (PROJ.replace(FOOT, "0.3048"), "international foot"),
        (PROJ.replace(FOOT, "0.001"), "0.001"),
        (PROJ2.replace(FOOT, "1", 1), "axis 1 is in the metre"),  # mixed axes
        (f'COMPD_CS["c",{PROJ},{VERT.replace(FOOT, "1.0")}]', "axis 3 is in the metre"),
        ('GEOGCS["US survey foot",UNIT["US survey foot",0.304800609601219]]', "geographic"),
        (f'COMPD_CS["c",GEOGCS["g",UNIT["degree",0.0174]],{VERT}]', "geographic"),
        (PROJ.replace(f'UNIT["US survey foot",{FOOT}],', ""), "no usable"),
        (PROJ.replace(FOOT, "0"), "no usable"),
        (PROJ.replace(FOOT, "-1"), "no usable"),
        (f'COMPD_CS["c",{PROJ},{VERT},{VERT.replace("1988", "1929")}]', "two horizontal axes"),
        (VERT, "two horizontal axes"),
        ("EPSG:2263", "read"),
        ('FOO["x"]', "read"),
    ],
)
def test_contradictions_are_refused(text, said):
    with pytest.raises(units.UnitError, match=said):
        record(text)


def test_an_unnamed_datum_is_none():
    r = record(f'COMPD_CS["c",{PROJ},{VERT.replace("North American Vertical Datum 1988", "unknown")}]')
    assert r["vertical"] == "declared" and r["vertical_datum"] is None and r["confirm"]


@pytest.mark.parametrize("assumed", [None, "", "feet", "ft", "metres", "international foot", 1])
def test_the_assumption_is_explicit(assumed):
    with pytest.raises(units.UnitError, match="must be stated"):
        record(None, assumed)
    with pytest.raises(TypeError):
        units.unit_record(None)


def header(*vlrs):
    """Header bytes with the given (record id, payload) of the projection user."""
    plain = bytearray(las.header_bytes(0, (1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), []))
    body = b"".join(struct.pack("<H16sHH32s", 0, b"LASF_Projection", k, len(d), b"") + d for k, d in vlrs)
    struct.pack_into("<II", plain, 96, len(plain) + len(body), len(vlrs))
    return las.Header.parse(bytes(plain) + body)


def test_systems_of_las_headers():
    assert units.survey_units(header(), "us survey foot")["horizontal"] == "assumed"
    assert units.survey_units(header((2112, f'COMPD_CS["c",{PROJ},{VERT}]'.encode() + b"\0")), "us survey foot")["vertical_datum"].startswith("North")
    with pytest.raises(units.UnitError, match="keys"):
        units.survey_units(header((34735, bytes(8))), "us survey foot")
