"""Driver queries of the engine, each with its SQL over the same tables.

The driver's tables hold no point cloud, so both sides derive one from `events` by the same exact arithmetic:
coordinates and heights are dyadic, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CLASSES, IDS, LAS_CODES, THRESHOLDS, Fusion
from .functions import scalar as S
from .operators import audit, fusion, inpainting, intervals, masks, matching, metrics, points, raster, stencil, transfer
from .operators import boxes as boxjoin
from .operators.grid import Grid
from .plans import experiments

GRID = Grid.of(0.0, 0.0, 128.0, 128.0, 2.0)
GROUND = GRID.coarse(32.0)
COARSE = GRID.coarse(4.0)
BOUNDS = (20.0, 30.0, 90.0, 100.0)
NAMES = [n for _, n, *_ in CLASSES]

QUERIES: dict = {}
SQL: dict[str, str] = {}


# --- derived views, on the Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", (((e * 7919) % 4096).cast("double") / 32).alias("x"), (((e * 104729) % 4096).cast("double") / 32).alias("y"))
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    block = (at("x", 16) + 2 * at("y", 16)) % 5
    height = F.when(block == 1, 10).when(block == 2, 7).when(block == 3, 1).otherwise(0)
    spot = (at("x", 16) + at("y", 16) + F.when(e % 10 == 0, 1).otherwise(0)) % 7
    code = F.get(F.array(*map(F.lit, (11, 3, 5, 6, 64, 1, 0))), spot)
    green = 18000 + ((at("x", 8) + at("y", 8)) % 4) * 3000 + (e * 641) % 2048
    return d.select(
        e.alias("orig_index"), "x", "y", (((e * 31337) % 64).cast("double") / 16 + height).alias("z"), (20000 + (e * 257) % 4096).cast("int").alias("red"), green.cast("int").alias("green"),
        (20000 + (e * 1031) % 4096).cast("int").alias("blue"), (e % 4096).cast("int").alias("intensity"), (1 + e % 5).cast("int").alias("number_of_returns"), code.cast("int").alias("classification"),
    )


def ptx(spark, sf_dir) -> DataFrame:
    return GRID.with_index(pts(spark, sf_dir)).withColumn("exg", S.exg())


def pth(spark, sf_dir) -> DataFrame:
    d = ptx(spark, sf_dir)
    return raster.height_above(d, GROUND, raster.lowest(d, GROUND), "z")


def grd(spark, sf_dir) -> DataFrame:
    s = raster.stat_grid(pth(spark, sf_dir), GRID, ["red", "green", "blue", "intensity", "hag"])
    return s.withColumns({"hag": S.f32(F.col("hag")), "exg": F.when(~F.col("void"), S.exg())})


def conf(d: DataFrame) -> DataFrame:
    return d.withColumns({n: S.f32(((F.col("r") * 31 + F.col("c") * 17 + i * 13) % 17).cast("float") / 16) for n, i in IDS.items()})


def doubles(d: DataFrame) -> DataFrame:
    return d.select(*[F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in d.dtypes])


# --- the same in SQL

_BASE = """
pt0 AS (SELECT event_id AS e, CAST((event_id*7919)%4096 AS DOUBLE)/32 AS x, CAST((event_id*104729)%4096 AS DOUBLE)/32 AS y FROM events),
pt1 AS (SELECT *, CAST(floor(x/16) AS INT) AS bx, CAST(floor(y/16) AS INT) AS by_, CAST(floor(x/8) AS INT) AS sx, CAST(floor(y/8) AS INT) AS sy FROM pt0),
pts AS (SELECT e AS orig_index, x, y, CAST((e*31337)%64 AS DOUBLE)/16 + CASE (bx+2*by_)%5 WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 1 ELSE 0 END AS z,
  CAST(20000+(e*257)%4096 AS INT) AS red, CAST(18000+((sx+sy)%4)*3000+(e*641)%2048 AS INT) AS green, CAST(20000+(e*1031)%4096 AS INT) AS blue,
  CAST(e%4096 AS INT) AS intensity, CAST(1+e%5 AS INT) AS number_of_returns,
  CAST([11,3,5,6,64,1,0][1 + CAST((bx+by_+CASE WHEN e%10=0 THEN 1 ELSE 0 END)%7 AS INT)] AS INT) AS classification FROM pt1),
ptf AS (SELECT *, CAST(red AS FLOAT) AS fr, CAST(green AS FLOAT) AS fg, CAST(blue AS FLOAT) AS fb,
  CAST(least(greatest(trunc((128-y)/2),0),63) AS INT) AS r, CAST(least(greatest(trunc(x/2),0),63) AS INT) AS c,
  CAST(least(greatest(trunc((128-y)/32),0),3) AS INT) AS gr, CAST(least(greatest(trunc(x/32),0),3) AS INT) AS gc FROM pts),
ptx AS (SELECT *, CAST((CAST(2 AS FLOAT)*fg - fr - fb) / (fr+fg+fb + CAST(1e-6 AS FLOAT)) AS FLOAT) AS exg FROM ptf),
ground AS (SELECT gr, gc, min(z) AS g FROM ptx GROUP BY gr, gc),
pth AS (SELECT ptx.*, CAST(z - g AS FLOAT) AS hag FROM ptx JOIN ground USING (gr, gc)),
cells AS (SELECT CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c FROM range(64) a(i), range(64) b(i)),
surface AS (SELECT r, c, max(CAST(z AS FLOAT)) AS surface_z FROM pth GROUP BY r, c),
near AS (SELECT pth.* FROM pth JOIN surface USING (r, c) WHERE CAST(z AS FLOAT) >= surface_z - CAST(1.5 AS FLOAT)),
means AS (SELECT r, c, count(*) AS n, avg(CAST(red AS DOUBLE)) AS red, avg(CAST(green AS DOUBLE)) AS green, avg(CAST(blue AS DOUBLE)) AS blue, avg(CAST(intensity AS DOUBLE)) AS intensity, CAST(avg(CAST(hag AS DOUBLE)) AS FLOAT) AS hag FROM near GROUP BY r, c),
grd0 AS (SELECT cells.r, cells.c, surface_z, n, red, green, blue, intensity, hag, surface_z IS NULL AS void, CAST(red AS FLOAT) AS fr, CAST(green AS FLOAT) AS fg, CAST(blue AS FLOAT) AS fb FROM cells LEFT JOIN surface USING (r, c) LEFT JOIN means USING (r, c)),
grd AS (SELECT *, CAST((CAST(2 AS FLOAT)*fg - fr - fb) / (fr+fg+fb + CAST(1e-6 AS FLOAT)) AS FLOAT) AS exg FROM grd0),
"""
_CONF = "conf AS (SELECT *, " + ", ".join(f"CAST(CAST((r*31+c*17+{i}*13)%17 AS FLOAT)/16 AS FLOAT) AS {n}" for n, i in IDS.items()) + " FROM grd),\n"


def _f(v) -> str:
    return f"CAST({v} AS FLOAT)"


_VETO = {
    "tree": f"(coalesce(exg > {_f(0.1)}, false) OR coalesce(hag > {_f(6)}, false))",
    "grass": f"(coalesce(exg > {_f(0.05)}, false) AND coalesce(hag < {_f(2)}, false))",
    "building": f"coalesce(hag > {_f(8)}, false)",
    **dict.fromkeys(("pavement", "sidewalk", "parking"), f"coalesce(hag < {_f(1.5)}, false)"),
    "vehicle": f"(coalesce(hag > {_f(1)}, false) AND coalesce(hag < {_f(9)}, false))",
}
_TALL = f"(coalesce(hag > {_f(6)}, false) AND NOT void)"


def _kept(constraints: bool = True, tree_check: bool = False) -> dict[str, str]:
    out = {}
    for n in NAMES:
        out[n] = f"({n} >= {_f(THRESHOLDS[n])} AND {_VETO[n] if constraints else 'true'} AND NOT void{' AND ' + _TALL if tree_check and n == 'tree' else ''})"
    return out


def _paint(kept: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {kept[n]} THEN {IDS[n]}" for n in Fusion().priority) + " ELSE -1 END"


def _mode(source: str, size: int = 5) -> str:
    h = size // 2
    return f"""(SELECT r, c, label FROM (SELECT r, c, label, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, label) AS k FROM (
      SELECT t.r, t.c, s.label, count(*) AS n FROM cells t, range(-{h},{h + 1}) a(i), range(-{h},{h + 1}) b(j), {source} s
      WHERE s.r = least(greatest(t.r+a.i,0),63) AND s.c = least(greatest(t.c+b.j,0),63) GROUP BY t.r, t.c, s.label)) WHERE k = 1)"""


def _score(label: str = "label") -> str:
    return f"CASE {label} " + " ".join(f"WHEN {i} THEN {n}" for n, i in IDS.items()) + f" ELSE {_f(0)} END"


def _fused(constraints=True, smoothing=True, size=5, tree_check=False, physical=False) -> str:
    """CTEs pre, sm and fused for a set of switches."""
    pre = f"pre AS (SELECT *, {_paint(_kept(constraints, tree_check))} AS label FROM conf),\n"
    sm = f"sm AS (SELECT conf.*, pre.label AS before, m.label AS after FROM conf JOIN pre USING (r, c) JOIN {_mode('pre', size) if smoothing else 'pre'} m USING (r, c)),\n"
    label = "after"
    if physical and smoothing:
        label = "CASE WHEN " + " OR ".join(f"(after = {i} AND {_VETO[n]} AND NOT void)" for n, i in IDS.items()) + " THEN after ELSE before END"
    if tree_check and smoothing:
        label = f"CASE WHEN ({label}) = 4 AND NOT {_TALL} THEN before ELSE ({label}) END"
    return pre + sm + f"fused0 AS (SELECT *, CAST({label} AS INT) AS label FROM sm),\nfused AS (SELECT *, {_score()} AS score FROM fused0),\n"


_RULE = f"CASE WHEN coalesce(hag > {_f(8)} AND exg <= {_f(0.05)}, false) THEN 5 WHEN coalesce(hag > {_f(6)} AND exg > {_f(0.05)}, false) THEN 4 WHEN coalesce(hag < {_f(2)} AND exg > {_f(0.05)}, false) THEN 3 WHEN coalesce(hag < {_f(1.5)} AND exg <= {_f(0.05)}, false) THEN 0 ELSE -1 END"


def _las(label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN {i} THEN {c}" for i, c in LAS_CODES.items()) + " END"


_PRED = f"pred AS (SELECT *, {_RULE} AS rule, {_las('(' + _RULE + ')')} AS pred, classification AS ref FROM pth),\n"
_DELTA = "(CAST(z AS FLOAT) - surface_z)"


def _transfer(band: float = 3.0, naive: bool = False) -> str:
    on = "true" if naive else f"coalesce(abs({_DELTA}) < {_f(band)}, false)"
    fall = f"CASE WHEN coalesce(hag > {_f(2)}, false) THEN 4 WHEN coalesce(exg > {_f(0.05)}, false) THEN 3 ELSE 0 END"
    return f"""view AS (SELECT r, c, label, score, surface_z FROM fused),
moved AS (SELECT pth.*, label, score, surface_z, {on} AS is_on, {fall} AS fall FROM pth JOIN view USING (r, c)),
sent AS (SELECT *, CAST(CASE WHEN is_on THEN label ELSE fall END AS INT) AS internal_class_id, CASE WHEN is_on AND label >= 0 THEN score END AS model_score,
  CAST(CASE WHEN is_on AND label >= 0 THEN 1 WHEN is_on THEN 0 WHEN surface_z IS NULL THEN 3 WHEN {_DELTA} > 0 THEN 4 ELSE 2 END AS INT) AS prediction_source, CASE WHEN is_on THEN 'transfer' ELSE 'fallback' END AS route FROM moved),
"""


def _sql(final: str, *ctes: str) -> str:
    return f"WITH {_BASE}{_CONF}{''.join(ctes)}last_ AS (SELECT 1) {final}"


def q(name: str, sql: str | None):
    def add(f):
        QUERIES[f"q_{name}"] = f
        if sql:
            SQL[f"q_{name}"] = sql
        return f

    return add


# --- scans, crops, scalar expressions


@q("grid_bounds", _sql("SELECT min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max, CAST(greatest(ceil((max(y)-min(y))/2),1) AS BIGINT) AS n_rows, CAST(greatest(ceil((max(x)-min(x))/2),1) AS BIGINT) AS n_cols, count(*) AS n FROM pts"))
def _(s, d):
    p = pts(s, d)
    g = Grid.of_points(p, 2.0)
    return p.agg(F.count(F.lit(1)).alias("n")).select(*[F.lit(getattr(g, k)).alias(k) for k in ("x_min", "y_min", "x_max", "y_max")], F.lit(g.rows).cast("long").alias("n_rows"), F.lit(g.cols).cast("long").alias("n_cols"), "n")


@q("cell_index", _sql("SELECT orig_index, r, c FROM ptx"))
def _(s, d):
    return ptx(s, d).select("orig_index", "r", "c")


@q("cell_center_roundtrip", _sql("SELECT r, c, CAST((c+0.5)*2 AS DOUBLE) AS x, CAST(128-(r+0.5)*2 AS DOUBLE) AS y, count(*) AS n FROM ptx GROUP BY r, c"))
def _(s, d):
    x, y = GRID.centre("_r", "_c")
    at = GRID.with_index(pts(s, d).select("x", "y"), "_r", "_c").select(x.alias("x"), y.alias("y"))
    return GRID.with_index(at).groupBy("r", "c", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@q("exg", _sql("SELECT orig_index, CAST(exg AS DOUBLE) AS exg FROM ptx"))
def _(s, d):
    return doubles(ptx(s, d).select("orig_index", "exg"))


@q("exg_audit", _sql("SELECT orig_index, (2*CAST(green AS DOUBLE)-red-blue)/(CAST(red AS DOUBLE)+green+blue) AS exg FROM pts"))
def _(s, d):
    return pts(s, d).select("orig_index", S.exg_audit().alias("exg"))


@q("crop_inclusive", _sql("SELECT orig_index, x, y, z FROM pts WHERE x BETWEEN 20 AND 90 AND y BETWEEN 30 AND 100"))
def _(s, d):
    return points.crop(pts(s, d), BOUNDS).select("orig_index", "x", "y", "z")


@q("crop_halfopen", _sql("SELECT orig_index, x, y, z FROM pts WHERE x >= 20 AND x < 90 AND y >= 30 AND y < 100"))
def _(s, d):
    return points.crop(pts(s, d), BOUNDS, closed=False).select("orig_index", "x", "y", "z")


@q("thin_every_k", _sql("SELECT orig_index, z FROM (SELECT *, row_number() OVER (ORDER BY orig_index) - 1 AS o FROM pts) WHERE o % 12 = 0"))
def _(s, d):
    return points.thin(pts(s, d)).select("orig_index", "z")


@q("las_codes", _sql(f"SELECT orig_index, {_las('rule')} AS las_code FROM pred", _PRED))
def _(s, d):
    return pth(s, d).select("orig_index", S.las_code(fusion.baseline()).alias("las_code"))


@q("code_names", _sql("SELECT p.code, name, count(*) AS n FROM (SELECT classification AS code FROM pts) p LEFT JOIN (VALUES (11, 'pavement/sidewalk/parking'), (3, 'grass'), (5, 'tree'), (6, 'building'), (64, 'vehicle')) t(code, name) ON p.code = t.code WHERE p.code IN (11, 3, 5, 6, 64) GROUP BY 1, 2"))
def _(s, d):
    found = pts(s, d).where(F.col("classification").isin(*{c for *_, c in CLASSES})).groupBy(F.col("classification").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("code", S.class_name(F.col("code")).alias("name"), "n")


@q("digest_check", "SELECT orig, orig ~ '^[0-9a-f]{64}$' AS is_digest FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE CAST(doc_id AS VARCHAR) END AS orig FROM documents)")
def _(s, d):
    v = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.col("doc_id").cast("string"))
    return table(s, d, "documents").select(v.alias("orig")).select("orig", S.is_sha256(F.col("orig")).alias("is_digest"))


@q("clean_text", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(coalesce(text,''), '_', ' '), '[!-/:-@\[-`{-~]', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS canonical FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.canonicalise(F.coalesce("text", F.lit(""))).alias("canonical"))


@q("file_codes", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 64 WHEN 3 THEN 11 END AS code, CAST(page_id % 7 AS INT) AS row0, CAST(page_id AS INT) AS col0 FROM pages")
def _(s, d):
    name = F.get(F.array(*map(F.lit, ("grass", "tree", "vehicle", "parking", "other"))), (F.col("page_id") % 5).cast("int"))
    p = table(s, d, "pages").select("page_id", F.concat(F.lit("tile_r"), F.col("page_id") % 7, F.lit("_c"), F.col("page_id"), F.lit("_"), name, F.lit(".las")).alias("f"))
    r, c = S.tile_offset(F.col("f"))
    return p.select("page_id", S.suffix_code(F.col("f")).alias("code"), r.alias("row0"), c.alias("col0"))


# --- rasters


@q("surface_max", _sql("SELECT r, c, CAST(surface_z AS DOUBLE) AS surface_z FROM surface"))
def _(s, d):
    return doubles(raster.surface_max(ptx(s, d)))


@q("decimate_min", _sql("SELECT CAST(least(greatest(trunc((128-y)/4),0),31) AS INT) AS r, CAST(least(greatest(trunc(x/4),0),31) AS INT) AS c, min(z) AS z FROM pts GROUP BY 1, 2"))
def _(s, d):
    return raster.lowest(pts(s, d), COARSE)


@q("near_surface_means", _sql("SELECT r, c, n, red, green, blue, intensity, CAST(hag AS DOUBLE) AS hag FROM means"))
def _(s, d):
    p = pth(s, d)
    m = raster.near_surface_means(p, raster.surface_max(p), GRID, ["red", "green", "blue", "intensity", "hag"])
    return m.withColumn("hag", S.f32(F.col("hag")).cast("double"))


@q("void_rate", _sql("SELECT count(*) AS cells, count(*) FILTER (WHERE void) AS void_cells, avg(CASE WHEN void THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS void_rate FROM grd"))
def _(s, d):
    return raster.void_rate(grd(s, d))


#: A grid of 4 million cells, too large to be broadcast.
FINE = Grid.of(0.0, 0.0, 128.0, 128.0, 0.0625)


@q("near_surface_fine", _sql("SELECT r, c, count(*) AS n, max(CAST(top AS DOUBLE)) AS surface_z, avg(CAST(red AS DOUBLE)) AS red, avg(CAST(intensity AS DOUBLE)) AS intensity FROM (SELECT r, c, z, red, intensity, max(CAST(z AS FLOAT)) OVER (PARTITION BY r, c) AS top FROM (SELECT *, CAST(least(greatest(trunc((128-y)*16),0),2047) AS INT) AS r, CAST(least(greatest(trunc(x*16),0),2047) AS INT) AS c FROM pts)) WHERE CAST(z AS FLOAT) >= top - CAST(4 AS FLOAT) GROUP BY r, c"))
def _(s, d):
    p = FINE.with_index(pts(s, d))
    top = raster.surface_max(p)
    return doubles(raster.near_surface_means(p, top, FINE, ["red", "intensity"], 4.0).join(top, ["r", "c"]).select("r", "c", "n", "surface_z", "red", "intensity"))


@q("rgb8", _sql("SELECT r, c, " + ", ".join(f"CAST(trunc(least(greatest(coalesce({x},0)/257,0),255)) AS INT) AS {x}8" for x in ("red", "green", "blue")) + " FROM grd"))
def _(s, d):
    return raster.rgb8(grd(s, d))


@q("hag", _sql("SELECT orig_index, CAST(hag AS DOUBLE) AS hag FROM pth"))
def _(s, d):
    return doubles(pth(s, d).select("orig_index", "hag"))


_LOW = "low AS (SELECT CAST(least(greatest(trunc((128-y)/4),0),31) AS INT) AS r, CAST(least(greatest(trunc(x/4),0),31) AS INT) AS c, min(z) AS z FROM pts WHERE classification IN (3, 11) GROUP BY 1, 2),\ncells32 AS (SELECT r, c FROM cells WHERE r < 32 AND c < 32),\n"
_LOWEST = "lowest AS (SELECT r, c, min(z) AS z FROM ptf GROUP BY r, c),\n"


def low(s, d):
    """The lowest ground point (by class) of each coarse cell; where there is none, the terrain has a gap."""
    return raster.lowest(pts(s, d).where(F.col("classification").isin(3, 11)), COARSE)


@q("low_outliers", _sql("""SELECT l.r, l.c, l.z, median, coalesce(l.z < median - 5 AND NOT isinf(median), false) AS outlier FROM lowest l JOIN (
  SELECT t.r, t.c, median(coalesce(s.z, CAST('Infinity' AS DOUBLE))) AS median FROM lowest t, range(-2,3) a(i), range(-2,3) b(j), cells k LEFT JOIN lowest s ON s.r = k.r AND s.c = k.c
  WHERE k.r = t.r+a.i AND k.c = t.c+b.j GROUP BY t.r, t.c) m USING (r, c)""", _LOWEST))
def _(s, d):
    m = stencil.low_outliers(raster.lowest(pts(s, d), GRID), GRID)
    return m.withColumn("median", F.coalesce("median", F.lit(float("inf"))))


def _box(source: str, value: str, size: int) -> str:
    lo, hi = size // 2, size - size // 2 - 1
    return f"(SELECT t.r, t.c, sum(s.{value}) AS v FROM cells32 t, range(-{lo},{hi + 1}) a(i), range(-{lo},{hi + 1}) b(j), {source} s WHERE s.r = least(greatest(t.r+a.i,0),31) AND s.c = least(greatest(t.c+b.j,0),31) GROUP BY t.r, t.c)"


_FULL = "full32 AS (SELECT k.r, k.c, coalesce(z, 0) AS v, CASE WHEN z IS NULL THEN 0 ELSE 1 END AS m, z FROM cells32 k LEFT JOIN low USING (r, c)),\n"


@q("box_mean", _sql(f"SELECT r, c, v/25 AS mean FROM {_box('full32', 'v', 5)}", _LOW, _FULL))
def _(s, d):
    return stencil.box_mean(COARSE.dense(low(s, d)).withColumn("z", F.coalesce("z", F.lit(0.0))), COARSE, 5, "z").select("r", "c", "mean")


@q("gapfill", _sql(f"""SELECT r, c, coalesce(f, (SELECT min(f) FROM filled)) AS z FROM filled""", _LOW, _FULL, f"filled AS (SELECT f.r, f.c, coalesce(f.z, CASE WHEN n5.v > 0 THEN d5.v/n5.v END, CASE WHEN n17.v > 0 THEN d17.v/n17.v END, CASE WHEN n65.v > 0 THEN d65.v/n65.v END) AS f FROM full32 f JOIN {_box('full32', 'v', 5)} d5 USING (r, c) JOIN {_box('full32', 'm', 5)} n5 USING (r, c) JOIN {_box('full32', 'v', 17)} d17 USING (r, c) JOIN {_box('full32', 'm', 17)} n17 USING (r, c) JOIN {_box('full32', 'v', 65)} d65 USING (r, c) JOIN {_box('full32', 'm', 65)} n65 USING (r, c)),\n"))
def _(s, d):
    return stencil.fill_gaps(COARSE.dense(low(s, d)), COARSE).select("r", "c", "z")


@q("bilinear", _sql("""SELECT t.r, t.c, CAST(CAST(sum(wr.w*wc.w*s.v) AS FLOAT) AS DOUBLE) AS dtm FROM cells t, LATERAL (SELECT (t.r+0.5::DOUBLE)/2-0.5 AS y, (t.c+0.5::DOUBLE)/2-0.5 AS x) p,
  LATERAL (SELECT CAST(least(greatest(floor(y)+k.i,0),31) AS INT) AS r, CASE k.i WHEN 0 THEN 1-(y-floor(y)) ELSE y-floor(y) END AS w FROM range(2) k(i)) wr,
  LATERAL (SELECT CAST(least(greatest(floor(x)+k.i,0),31) AS INT) AS c, CASE k.i WHEN 0 THEN 1-(x-floor(x)) ELSE x-floor(x) END AS w FROM range(2) k(i)) wc
  JOIN full32 s ON s.r = wr.r AND s.c = wc.c GROUP BY t.r, t.c""", _LOW, _FULL))
def _(s, d):
    c = COARSE.dense(low(s, d)).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return doubles(stencil.bilinear(c, COARSE, GRID))


@q("density", _sql("SELECT CAST(k.i AS INT) AS r, CAST(l.i AS INT) AS c, count(p.orig_index) AS n FROM range(70) k(i), range(70) l(i) LEFT JOIN (SELECT orig_index, floor(y-30) AS pr, floor(x-20) AS pc FROM pts WHERE x >= 20 AND x < 90 AND y >= 30 AND y < 100) p ON pr = k.i AND pc = l.i GROUP BY 1, 2"))
def _(s, d):
    return raster.density(points.crop(pts(s, d), BOUNDS, closed=False), BOUNDS)


@q("density_stats", _sql("""SELECT CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (WHERE n > 0) AS occupied, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS occupancy, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_all, quantile_cont(CAST(n AS DOUBLE), 0.9) AS p90_all, quantile_cont(CAST(n AS DOUBLE), 0.5) FILTER (WHERE n > 0) AS median_occupied, max(n) AS most FROM (
  SELECT k.i AS r, l.i AS c, count(p.orig_index) AS n FROM range(70) k(i), range(70) l(i) LEFT JOIN (SELECT orig_index, floor(y-30) AS pr, floor(x-20) AS pc FROM pts WHERE x >= 20 AND x < 90 AND y >= 30 AND y < 100) p ON pr = k.i AND pc = l.i GROUP BY 1, 2)"""))
def _(s, d):
    return raster.density_stats(raster.density(points.crop(pts(s, d), BOUNDS, closed=False), BOUNDS))


# --- fusion and rules


@q("veto", _sql("SELECT r, c, " + ", ".join(f"({v} AND NOT void) AS {n}" for n, v in _VETO.items()) + " FROM grd"))
def _(s, d):
    return grd(s, d).select("r", "c", *[fusion.veto(n).alias(n) for n in NAMES])


@q("priority_paint", _sql(f"SELECT r, c, CAST({_paint(_kept())} AS INT) AS label FROM conf"))
def _(s, d):
    return fusion.fuse(conf(grd(s, d)), GRID, Fusion(smoothing=False)).select("r", "c", "label")


@q("majority", _sql(f"SELECT r, c, CAST(label AS INT) AS label FROM {_mode('pre')}", _fused()))
def _(s, d):
    c = conf(grd(s, d))
    pre = c.withColumn("label", fusion.paint({n: k for n, (_, k) in fusion.claims(Fusion()).items()}, Fusion().priority))
    return stencil.majority(pre, GRID).select("r", "c", "label")


@q("majority_9", _sql("SELECT r, c, label, CAST(score AS DOUBLE) AS score FROM fused", _fused(size=9)))
def _(s, d):
    return doubles(fusion.fuse(conf(grd(s, d)), GRID, Fusion(window=9)))


for _name, _options in {"fuse": {}, "fuse_tree_check": {"tree_height_check": True}, "fuse_physical": {"physical_smoothing": True}, "fuse_both": {"tree_height_check": True, "physical_smoothing": True}, "fuse_unconstrained": {"constraints": False}}.items():
    _sql_options = {{"tree_height_check": "tree_check", "physical_smoothing": "physical"}.get(k, k): v for k, v in _options.items()}
    q(_name, _sql("SELECT r, c, label, CAST(score AS DOUBLE) AS score FROM fused", _fused(**_sql_options)))(lambda s, d, o=_options: doubles(fusion.fuse(conf(grd(s, d)), GRID, Fusion(**o))))


@q("veto_stats", _sql(" UNION ALL ".join(f"SELECT '{n}' AS class, count(*) FILTER (WHERE {n} >= {_f(THRESHOLDS[n])}) AS claimed_px, count(*) FILTER (WHERE {k}) AS kept_px, 1 - CAST(count(*) FILTER (WHERE {k}) AS DOUBLE)/nullif(count(*) FILTER (WHERE {n} >= {_f(THRESHOLDS[n])}), 0) AS vetoed FROM conf" for n, k in _kept().items())))
def _(s, d):
    return fusion.veto_stats(conf(grd(s, d)))


@q("baseline", _sql("SELECT orig_index, CAST(rule AS INT) AS label FROM pred", _PRED))
def _(s, d):
    return pth(s, d).select("orig_index", fusion.baseline().alias("label"))


@q("rule_proposals", _sql("SELECT orig_index, " + ", ".join(f"CAST(rule = {i} AS DOUBLE) AS {n}" for n, i in IDS.items()) + " FROM pred", _PRED))
def _(s, d):
    p = fusion.proposals(fusion.baseline())
    return doubles(pth(s, d).select("orig_index", *[v.alias(n) for n, v in p.items()]))


@q("geometry_only", _sql(f"SELECT orig_index, CASE WHEN coalesce(hag > {_f(6)}, false) THEN 4 WHEN coalesce(hag < {_f(2)}, false) THEN 3 ELSE -1 END AS label FROM pth"))
def _(s, d):
    return pth(s, d).select("orig_index", fusion.geometry_only().alias("label"))


# --- transfer


def viewed(s, d):
    g = grd(s, d)
    return GRID.gather(pth(s, d), fusion.fuse(conf(g), GRID).join(g.select("r", "c", "surface_z"), ["r", "c"]))


_SENT = "SELECT orig_index, internal_class_id, CAST(model_score AS DOUBLE) AS model_score, prediction_source, route FROM sent"
for _name, _args in {"transfer_provenance": {}, "transfer_naive": {"mode": "naive"}, "transfer_band": {"band": 1.5}}.items():
    q(_name, _sql(_SENT, _fused(), _transfer(_args.get("band", 3.0), "mode" in _args)))(lambda s, d, a=_args: doubles(transfer.transfer(viewed(s, d), **a).select("orig_index", "internal_class_id", "model_score", "prediction_source", "route")))


@q("transfer_legacy", _sql("SELECT orig_index, internal_class_id AS label_out, CAST(CASE WHEN is_on THEN trunc(score*CAST(255 AS FLOAT)) ELSE 128 END AS INT) AS conf_out FROM sent", _fused(), _transfer()))
def _(s, d):
    return transfer.transfer_legacy(viewed(s, d)).select("orig_index", "label_out", "conf_out")


@q("surface_strata", _sql(f"SELECT orig_index, coalesce(abs({_DELTA}) < 3, false) AS on_surface, coalesce(NOT abs({_DELTA}) < 3 AND {_DELTA} <= 0, false) AS below_surface, coalesce(NOT abs({_DELTA}) < 3 AND {_DELTA} > 0, false) AS above_surface, surface_z IS NULL AS missing_surface FROM pth LEFT JOIN surface USING (r, c)"))
def _(s, d):
    p = pth(s, d)
    return raster.surface_strata(GRID.gather(p, raster.surface_max(p)), 3.0).select("orig_index", "on_surface", "below_surface", "above_surface", "missing_surface")


@q("class_distribution", _sql("SELECT CAST(i AS INT) AS label, count(orig_index) AS n, CAST(count(orig_index) AS DOUBLE)/(SELECT count(*) FROM pred) AS share FROM range(-1,7) k(i) LEFT JOIN pred ON rule = i GROUP BY i", _PRED))
def _(s, d):
    return metrics.class_distribution(pth(s, d).select(fusion.baseline().alias("label")))


# --- alignment and scores


def halves(s, d):
    """Two point sets: codes of the cloud, and rule codes of 4 in 5 points with some ids twice."""
    t = pth(s, d).withColumn("ordinal", F.col("orig_index"))
    p = t.withColumn("classification", S.las_code(fusion.baseline())).where("orig_index % 5 <> 0")
    return t, p.unionByName(p.where("orig_index % 50 = 1").withColumns({"ordinal": F.col("ordinal") + 1000000, "classification": F.lit(99)}))


_MATCH = "matched AS (SELECT orig_index, ref AS gt, pred FROM pred WHERE orig_index % 5 <> 0),\n"


@q("match_by_id", _sql("SELECT orig_index, gt, pred FROM matched", _PRED, _MATCH))
def _(s, d):
    return matching.match_by_id(*halves(s, d)).select("orig_index", "gt", "pred")


_XYZ = "keyed AS (SELECT round_even(x,2) AS kx, round_even(y,2) AS ky, round_even(z,2) AS kz, orig_index, ref, pred FROM pred),\ntruth AS (SELECT kx, ky, kz, arg_min(ref, orig_index) AS gt FROM keyed GROUP BY ALL),\nguess AS (SELECT kx, ky, kz, arg_min(pred, orig_index) AS pred FROM keyed WHERE orig_index % 5 <> 0 GROUP BY ALL),\n"


@q("match_by_xyz", _sql("SELECT kx, ky, kz, gt, pred FROM truth JOIN guess USING (kx, ky, kz)", _PRED, _XYZ))
def _(s, d):
    t, p = halves(s, d)
    return matching.match_by_xyz(t, p)


_SQUARE = "codes AS (SELECT DISTINCT code FROM (SELECT unnest([1,3,5,6,11,64]) AS code UNION ALL SELECT gt FROM m2 UNION ALL SELECT pred FROM m2)),\ncm AS (SELECT a.code AS gt, b.code AS pred, count(m2.gt) AS count FROM codes a CROSS JOIN codes b LEFT JOIN m2 ON m2.gt = a.code AND m2.pred = b.code GROUP BY 1, 2),\n"
_M2 = "m2 AS (SELECT * FROM matched WHERE gt NOT IN (0, 1)),\n"


@q("confusion", _sql("SELECT gt, pred, count FROM cm", _PRED, _MATCH, _M2, _SQUARE))
def _(s, d):
    return metrics.confusion(matching.match_by_id(*halves(s, d)).where(matching.reviewed()))


@q("iou", _sql("SELECT code, CAST(sum(CASE WHEN gt = pred THEN count ELSE 0 END) AS BIGINT) AS tp, CAST(sum(count) AS BIGINT) AS denominator, CAST(sum(CASE WHEN gt = pred THEN count ELSE 0 END) AS DOUBLE)/nullif(CAST(sum(count) AS DOUBLE), 0) AS iou FROM codes JOIN cm ON code = gt OR code = pred GROUP BY code", _PRED, _MATCH, _M2, _SQUARE))
def _(s, d):
    return metrics.iou(metrics.confusion(matching.match_by_id(*halves(s, d)).where(matching.reviewed())))


@q("baseline_iou", _sql("SELECT code, CAST(sum(CASE WHEN gt = pred THEN count ELSE 0 END) AS BIGINT) AS tp, CAST(sum(count) AS BIGINT) AS denominator, CAST(sum(CASE WHEN gt = pred THEN count ELSE 0 END) AS DOUBLE)/nullif(CAST(sum(count) AS DOUBLE), 0) AS iou FROM codes JOIN cm ON code = gt OR code = pred GROUP BY code", _PRED, "m2 AS (SELECT ref AS gt, pred FROM pred WHERE ref NOT IN (0, 1)),\n", _SQUARE))
def baseline_iou(s, d):
    p = pth(s, d).select(F.col("classification").alias("gt"), S.las_code(fusion.baseline()).alias("pred"))
    return metrics.iou(metrics.confusion(p.where(matching.reviewed())))


def scored(s, d):
    p = pth(s, d)
    surf = raster.surface_max(p)
    p = raster.surface_strata(GRID.gather(p, surf), 3.0)
    code = F.when(F.col("orig_index") % 97 == 0, 77).otherwise(S.las_code(fusion.baseline()))
    return p.select("orig_index", "x", F.col("classification").alias("ref"), code.alias("pred"), "on_surface", "below_surface", (F.col("z") > 1000).alias("never"), F.when(F.col("orig_index") % 3 == 0, "transfer").otherwise("fallback").alias("route"))


_OUT = f"""scored AS (SELECT orig_index, x, ref, CASE WHEN orig_index % 97 = 0 THEN 77 ELSE pred END AS pred, coalesce(abs({_DELTA}) < 3, false) AS on_surface, coalesce(NOT abs({_DELTA}) < 3 AND {_DELTA} <= 0, false) AS below_surface, z > 1000 AS never, CASE WHEN orig_index % 3 = 0 THEN 'transfer' ELSE 'fallback' END AS route FROM pred LEFT JOIN surface USING (r, c)),
o AS (SELECT *, CASE WHEN pred IN (3,5,6,11,64) THEN CAST(pred AS VARCHAR) WHEN pred = 1 THEN 'unlabelled' ELSE 'invalid' END AS prediction FROM scored WHERE ref IN (3,5,6,11,64)),
rc AS (SELECT unnest([3,5,6,11,64]) AS code),
"""


def _class_rows(group: str = "", where: str = "true") -> str:
    """Per-class rows of table o, by an optional group column."""
    g = f"{group}, " if group else ""
    src = f"(SELECT DISTINCT {group} FROM o) g CROSS JOIN" if group else ""
    on = f" AND o.{group} = g.{group}" if group else ""
    return f"""(SELECT {'g.' + group + ' AS ' + group + ',' if group else ''} code, count(*) FILTER (WHERE ref = code) AS support, count(*) FILTER (WHERE ref = code AND prediction = CAST(code AS VARCHAR)) AS tp,
      count(*) FILTER (WHERE ref <> code AND prediction = CAST(code AS VARCHAR)) AS fp, count(*) FILTER (WHERE ref = code AND prediction = 'unlabelled') AS un, count(*) FILTER (WHERE ref = code AND prediction = 'invalid') AS inv
      FROM {src} rc LEFT JOIN o ON {where}{on} GROUP BY {'g.' + group + ',' if group else ''} code)"""


_RATIOS = "CASE WHEN support > 0 THEN CAST(support - tp AS DOUBLE)/support END"
_IOU = "CASE WHEN support > 0 THEN CAST(tp AS DOUBLE)/(fp+support) END"
_SUMMARY = f"CAST(sum(support) AS BIGINT) AS scored_points, CAST(sum(tp) AS BIGINT) AS correct_points, CAST(sum(un) AS BIGINT) AS unlabelled_points, CAST(sum(inv) AS BIGINT) AS invalid_points, avg({_RATIOS}) AS primary_loss"


@q("confusion_strict", _sql("SELECT ref AS reference, prediction, count(*) AS count FROM o GROUP BY 1, 2", _PRED, _OUT))
def _(s, d):
    return metrics.confusion_strict(scored(s, d))


@q("per_class", _sql(f"SELECT code, CASE code WHEN 3 THEN 'grass' WHEN 5 THEN 'tree' WHEN 6 THEN 'building' WHEN 11 THEN 'pavement' ELSE 'vehicle' END AS class_name, support > 0 AS present, support, tp+fp AS predicted_count, tp AS true_positive, fp AS false_positive, support-tp AS false_negative, {_RATIOS} AS error_loss, CASE WHEN support > 0 AND tp+fp > 0 THEN CAST(tp AS DOUBLE)/(tp+fp) END AS precision, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE)/support END AS recall, CASE WHEN support > 0 THEN CAST(2*tp AS DOUBLE)/(tp+fp+support) END AS f1, {_IOU} AS iou, un AS unlabelled_count, inv AS invalid_count FROM {_class_rows()}", _PRED, _OUT))
def _(s, d):
    return metrics.per_class(metrics.confusion_strict(scored(s, d)))


def brief(d: DataFrame, *by: str) -> DataFrame:
    return d.select(*by, "scored_points", "correct_points", "unlabelled_points", "invalid_points", F.bround("primary_loss", 12).alias("primary_loss"))


_BRIEF = "scored_points, correct_points, unlabelled_points, invalid_points, round_even(primary_loss, 12) AS primary_loss"


@q("balanced_loss", _sql(f"SELECT {_BRIEF} FROM (SELECT {_SUMMARY} FROM {_class_rows()})", _PRED, _OUT))
def _(s, d):
    return brief(metrics.score(scored(s, d)))


@q("strata", _sql(" UNION ALL ".join(f"SELECT '{m}' AS stratum, {_BRIEF}, CAST(scored_points AS DOUBLE)/(SELECT count(*) FROM o) AS share FROM (SELECT {_SUMMARY} FROM {_class_rows(where=m)})" for m in ("on_surface", "below_surface", "never")), _PRED, _OUT))
def _(s, d):
    r = metrics.strata_scores(scored(s, d), ["on_surface", "below_surface", "never"])
    counts = ["correct_points", "unlabelled_points", "invalid_points"]
    return brief(r.fillna(0, counts).withColumn("_s", F.col("share_of_reviewed_points")), "stratum", "_s").withColumnRenamed("_s", "share")


@q("routes", _sql(" UNION ALL ".join(f"SELECT '{m}' AS route, {_BRIEF}, CAST(scored_points AS DOUBLE)/(SELECT count(*) FROM o) AS share, (SELECT count(*) FROM scored WHERE route = '{m}') AS all_points FROM (SELECT {_SUMMARY} FROM {_class_rows(where=f"o.route = '{m}'")})" for m in ("transfer", "fallback", "unknown")), _PRED, _OUT))
def _(s, d):
    p = scored(s, d)
    r = metrics.route_scores(p, p).fillna(0, ["correct_points", "unlabelled_points", "invalid_points"])
    return brief(r.withColumnsRenamed({"share_of_reviewed_points": "share", "all_prediction_points": "all_points"}), "route", "share", "all_points")


@q("regions", _sql(f"SELECT count(region) AS regions, round_even(avg(primary_loss), 12) AS macro_loss FROM (SELECT region, {_SUMMARY} FROM {_class_rows('region')} GROUP BY region)", _PRED, _OUT.replace("o AS (SELECT *,", "o AS (SELECT *, CAST(floor(x/64) AS INT) AS region,")))
def _(s, d):
    p = scored(s, d).withColumn("region", F.floor(F.col("x") / 64).cast("int"))
    m = metrics.region_mean(metrics.score(p, ["region"]))
    return m.withColumn("macro_loss", F.bround("macro_loss", 12))


@q("integrity", _sql("""SELECT count(a.orig_index) AS reference_points, count(b.orig_index) AS prediction_points, count(*) FILTER (WHERE rv) AS expected_reviewed_points, count(*) FILTER (WHERE rv AND b.orig_index IS NOT NULL) AS matched_reviewed_points, count(*) FILTER (WHERE rv AND b.orig_index IS NULL) AS missing_reviewed_points, count(*) FILTER (WHERE NOT rv) AS unreviewed_reference_points, count(*) FILTER (WHERE NOT rv AND b.orig_index IS NULL) AS missing_unreviewed_points, count(*) FILTER (WHERE a.orig_index IS NULL) AS extra_prediction_points
  FROM (SELECT orig_index, classification IN (3,5,6,11,64) AS rv FROM pts WHERE orig_index % 11 <> 0) a FULL JOIN (SELECT orig_index FROM pts WHERE orig_index % 13 <> 0) b ON a.orig_index = b.orig_index"""))
def _(s, d):
    p = pts(s, d).select(F.col("orig_index").alias("id"), F.col("classification").alias("ref"))
    return matching.integrity(p.where("id % 11 <> 0"), p.where("id % 13 <> 0").withColumn("pred", F.col("ref")))


@q("boundary", _sql("SELECT a.orig_index, EXISTS (SELECT 1 FROM own b WHERE b.classification <> a.classification AND b.x BETWEEN a.x-1 AND a.x+1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1) OR least(a.x, a.y, 128-a.x, 128-a.y) <= 1 AS boundary FROM own a", "own AS (SELECT * FROM pts WHERE classification IN (3,5,6,11,64)),\n"))
def _(s, d):
    return matching.near_other_class(pts(s, d), 1.0, (0.0, 0.0, 128.0, 128.0)).select("orig_index", "boundary")


@q("perimeter", _sql("SELECT orig_index, least(x-20, y-30, 90-x, 100-y) AS distance FROM pts"))
def _(s, d):
    return pts(s, d).select("orig_index", S.perimeter_distance(F.col("x"), F.col("y"), BOUNDS).alias("distance"))


@q("geometry_match", _sql("SELECT CAST(count(a.i) AS BIGINT) AS left_rows, CAST(count(b.i) AS BIGINT) AS right_rows, count(*) FILTER (WHERE a.i IS NULL OR b.i IS NULL) AS unmatched, count(*) FILTER (WHERE a.i IS NOT NULL AND b.i IS NOT NULL AND a.v <> b.v) AS differing FROM (SELECT orig_index AS i, red AS v FROM pts WHERE orig_index % 11 <> 0) a FULL JOIN (SELECT orig_index AS i, red + CASE WHEN orig_index % 17 = 0 THEN 1 ELSE 0 END AS v FROM pts) b ON a.i = b.i"))
def _(s, d):
    p = pts(s, d).select("orig_index", F.col("red").alias("x_raw"))
    return matching.geometry_mismatches(p.where("orig_index % 11 <> 0"), p.withColumn("x_raw", F.col("x_raw") + F.when(F.col("orig_index") % 17 == 0, 1).otherwise(0)), columns=("x_raw",))


# --- audits


@q("value_hist", _sql("SELECT channel, value, count(*) AS n FROM (SELECT 'red' AS channel, red AS value FROM pts UNION ALL SELECT 'green', green FROM pts UNION ALL SELECT 'blue', blue FROM pts) GROUP BY 1, 2"))
def _(s, d):
    return audit.value_histogram(pts(s, d), ["red", "green", "blue"])


@q("quantiles", _sql("SELECT count(z) AS n, min(z) AS least, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.9) AS p90, quantile_cont(z, 0.99) AS p99, max(z) AS most, avg(z) AS mean FROM pts"))
def _(s, d):
    return audit.quantiles(pts(s, d), "z")


@q("hist_quantiles", _sql("SELECT channel, count(*) AS n, min(value) AS least, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median, quantile_cont(CAST(value AS DOUBLE), 0.9) AS p90, quantile_cont(CAST(value AS DOUBLE), 0.99) AS p99, max(value) AS most FROM (SELECT 'red' AS channel, red AS value FROM pts UNION ALL SELECT 'green', green FROM pts) GROUP BY 1"))
def _(s, d):
    return audit.histogram_quantiles(audit.value_histogram(pts(s, d), ["red", "green"]))


@q("rgb_patterns", _sql("SELECT channel, count(*) AS n, count(DISTINCT value) AS distinct_values, count(*) FILTER (WHERE value=0) AS zero, count(*) FILTER (WHERE value=255) AS v255, count(*) FILTER (WHERE value=65535) AS v65535, count(*) FILTER (WHERE value%256=0) AS by256, count(*) FILTER (WHERE value%257=0) AS by257 FROM (SELECT 'red' AS channel, red AS value FROM pts UNION ALL SELECT 'blue', blue FROM pts) GROUP BY 1"))
def _(s, d):
    return audit.rgb_patterns(audit.value_histogram(pts(s, d), ["red", "blue"]))


@q("rgb_endpoints", _sql("SELECT count(*) FILTER (WHERE red=0 OR green=0 OR blue=0) AS any_zero, count(*) FILTER (WHERE red=0 AND green=0 AND blue=0) AS all_zero, count(*) FILTER (WHERE red=65535 OR green=65535 OR blue=65535) AS any_max, count(*) FILTER (WHERE red=65535 AND green=65535 AND blue=65535) AS all_max, count(*) FILTER (WHERE red<=255 AND green<=255 AND blue<=255) AS all_le255 FROM pts"))
def _(s, d):
    return audit.rgb_endpoints(pts(s, d))


@q("hag_stats", _sql("SELECT count(*) AS points, count(h) AS finite, count(*) FILTER (WHERE h < 0) AS negative, count(*) FILTER (WHERE h = 0) AS zero, avg(CASE WHEN h < 0 THEN 1.0::DOUBLE WHEN h IS NOT NULL THEN 0.0::DOUBLE END) AS negative_share FROM (SELECT CASE WHEN orig_index % 9 <> 0 THEN hag - CAST(1 AS FLOAT) END AS h FROM pth)"))
def _(s, d):
    return audit.height_stats(pth(s, d).withColumn("hag", F.when(F.col("orig_index") % 9 != 0, F.col("hag") - S.f32(1.0))))


@q("class_hist", _sql("SELECT classification AS code, count(*) AS n FROM pts WHERE x >= 20 AND x < 90 AND y >= 30 AND y < 100 GROUP BY 1"))
def _(s, d):
    return audit.class_histogram(points.crop(pts(s, d), BOUNDS, closed=False))


@q("dup_ids", _sql("SELECT i AS orig_index, count(*) AS copies FROM (SELECT orig_index // 2 * 2 AS i FROM pts WHERE orig_index % 3 = 0 OR orig_index % 4 = 1) GROUP BY 1 HAVING count(*) > 1"))
def _(s, d):
    return points.duplicates(pts(s, d).where("orig_index % 3 = 0 or orig_index % 4 = 1").select(F.expr("orig_index div 2 * 2").alias("orig_index")))


@q("part_conflicts", _sql("SELECT i AS orig_index, min(k) AS lowest, max(k) AS highest, count(DISTINCT k) AS classes FROM (SELECT orig_index AS i, 3 AS k FROM pts WHERE orig_index % 4 = 0 UNION ALL SELECT orig_index, 5 FROM pts WHERE orig_index % 6 = 0) GROUP BY 1 HAVING count(DISTINCT k) > 1"))
def _(s, d):
    p = pts(s, d).select("orig_index")
    return matching.conflicts(p.where("orig_index % 4 = 0").withColumn("classification", F.lit(3)).unionByName(p.where("orig_index % 6 = 0").withColumn("classification", F.lit(5))))


@q("merge_parts", _sql("SELECT orig_index, CASE WHEN orig_index % 4 = 0 THEN 3 WHEN orig_index % 4 = 1 THEN 5 ELSE 1 END AS classification FROM pts"))
def _(s, d):
    p = pts(s, d).select("orig_index")
    return matching.merge_parts(p, {3: p.where("orig_index % 4 = 0"), 5: p.where("orig_index % 4 = 1")})


@q("restore_labels", _sql("SELECT orig_index, orig_index AS tile_index, x, y, z, classification FROM pts WHERE orig_index % 3 = 1"))
def _(s, d):
    t = points.ordinal(pts(s, d), "orig_index", "tile_index")
    part = t.where("orig_index % 3 = 1").select("tile_index", "x", "y", "z", "classification")
    return matching.restore(t.select("tile_index", "orig_index", "x", "y", "z"), part)


@q("anti_ids", _sql("SELECT orig_index FROM pts WHERE orig_index % 10 = 7"))
def _(s, d):
    p = pts(s, d).select("orig_index")
    return matching.unknown_ids(p, p.where("orig_index % 10 <> 7"))


_AUDIT = "cellz AS (SELECT r, c, max(z) AS z, max(exg) AS exg FROM ptx GROUP BY r, c),\nspread AS (SELECT t.r, t.c, max(s.z)-min(s.z) AS z_range, max(s.exg)-min(s.exg) AS exg_range, count(*) < 9 AS empty_neighbour FROM cellz t JOIN cellz s ON s.r BETWEEN t.r-1 AND t.r+1 AND s.c BETWEEN t.c-1 AND t.c+1 GROUP BY t.r, t.c),\n"


def spread(s, d):
    return stencil.ranges(ptx(s, d).groupBy("r", "c").agg(F.max("z").alias("z"), F.max("exg").alias("exg")), GRID)


@q("audit_boundary", _sql("SELECT r, c, z_range, CAST(exg_range AS DOUBLE) AS exg_range, empty_neighbour, empty_neighbour OR z_range > 2 OR CAST(exg_range AS DOUBLE) > 0.05::DOUBLE AS boundary FROM spread", _AUDIT))
def _(s, d):
    m = spread(s, d).withColumn("exg_range", F.col("exg_range").cast("double"))
    return m.select("r", "c", "z_range", "exg_range", "empty_neighbour", stencil.boundary_flag().alias("boundary"))


_STRATUM = "strat AS (SELECT ((CASE WHEN hag IS NULL THEN 3 WHEN hag < 2 THEN 0 WHEN hag <= 6 THEN 1 ELSE 2 END)*3 + CASE WHEN CAST(exg AS DOUBLE) <= 0.05::DOUBLE THEN 0 ELSE 1 END)*2 + CASE WHEN intensity % 2 = 0 THEN 1 ELSE 0 END AS stratum FROM pth),\n"


@q("strata_counts", _sql("SELECT CAST(k.i AS INT) AS stratum, count(s.stratum) AS available, least(count(s.stratum), 50) AS drawn, CAST(least(count(s.stratum), 50) AS DOUBLE)/nullif(count(s.stratum), 0) AS inclusion_probability FROM range(24) k(i) LEFT JOIN strat s ON s.stratum = k.i GROUP BY k.i", _STRATUM))
def _(s, d):
    p = pth(s, d).select(audit.stratum_code(F.col("hag"), F.col("exg").cast("double"), F.col("intensity") % 2 == 0).alias("stratum"))
    return points.stratum_counts(p, "stratum", 50, 24).toDF("stratum", "available", "drawn", "inclusion_probability")


@q("equality_audit", _sql("SELECT count(*) AS rows, count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS changed, max(abs(a.v-b.v)) AS greatest_difference FROM (SELECT orig_index AS i, CASE WHEN orig_index % 5 <> 0 THEN z END AS v FROM pts) a FULL JOIN (SELECT orig_index AS i, CASE WHEN orig_index % 5 <> 0 THEN z + CASE WHEN orig_index % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END END AS v FROM pts) b USING (i)"))
def _(s, d):
    v = F.when(F.col("orig_index") % 5 != 0, F.col("z"))
    a = pts(s, d).withColumn("v", v)
    return audit.compare(a, a.withColumn("v", v + F.when(F.col("orig_index") % 3 == 0, 0.25).otherwise(0.0)), ["orig_index"], "v")


@q("exg_hist", _sql("SELECT CAST(least(floor((CAST(exg AS DOUBLE)+0.5::DOUBLE)/(1.5::DOUBLE/200)), 199) AS INT) AS bin, count(*) AS n FROM ptx WHERE exg BETWEEN -0.5 AND 1 GROUP BY 1"))
def _(s, d):
    return audit.exg_histogram(ptx(s, d))


# --- masks, boxes, tiles


def mask_rows(s, d):
    bits = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("class"), ((F.col("label") + 1) / 16).cast("float").alias("score"), masks.rle_encode(bits).alias("counts"), F.lit(8).alias("h"), F.lit(8).alias("w"))


_BITS = "bits AS (SELECT vec_id, label, CAST((label+1)/16.0 AS DOUBLE) AS score, u.i - 1 AS p, CASE WHEN embedding[u.i] > 0 THEN 1 ELSE 0 END AS b FROM embeddings, range(1,65) u(i)),\n"


@q("rle_encode", f"WITH {_BITS} ch AS (SELECT *, CASE WHEN b = coalesce(lag(b) OVER (PARTITION BY vec_id ORDER BY p), 0) THEN 0 ELSE 1 END AS f FROM bits), rn AS (SELECT *, sum(f) OVER (PARTITION BY vec_id ORDER BY p) AS k FROM ch), lens AS (SELECT vec_id, k, count(*) AS n FROM rn GROUP BY 1, 2) SELECT vec_id, CASE WHEN min(k) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS counts FROM lens GROUP BY vec_id")
def _(s, d):
    return mask_rows(s, d).select("vec_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@q("rle_decode", f"WITH {_BITS} e AS (SELECT 1) SELECT vec_id, CAST(p // 8 AS INT) AS r, CAST(p % 8 AS INT) AS c FROM bits WHERE b = 1")
def _(s, d):
    return masks.rle_decode(mask_rows(s, d)).select("vec_id", "r", "c")


@q("mask_union", f"WITH {_BITS} e AS (SELECT 1) SELECT vec_id // 10 AS tile, CAST(p // 8 AS INT) AS r, CAST(p % 8 AS INT) AS c, max(score) AS score FROM bits WHERE b = 1 GROUP BY 1, 2, 3")
def _(s, d):
    return doubles(masks.union_masks(mask_rows(s, d).withColumn("tile", F.expr("vec_id div 10")), ["tile"]))


@q("mask_union_runs", f"WITH {_BITS} px AS (SELECT vec_id // 10 AS tile, CAST(p // 8 AS INT) AS r, CAST(p % 8 AS INT) AS c, max(score) AS score FROM bits WHERE b = 1 GROUP BY 1, 2, 3), st AS (SELECT *, CASE WHEN lag(c) OVER w = c - 1 AND lag(score) OVER w = score THEN 0 ELSE 1 END AS f FROM px WINDOW w AS (PARTITION BY tile, r ORDER BY c)), g AS (SELECT *, sum(f) OVER (PARTITION BY tile, r ORDER BY c) AS k FROM st) SELECT tile, r, min(c) AS b, max(c) + 1 AS e, max(score) AS score FROM g GROUP BY tile, r, k")
def _(s, d):
    return doubles(intervals.union(intervals.of_runs(mask_rows(s, d).withColumn("tile", F.expr("vec_id div 10"))), ["tile"]).select("tile", "r", "b", "e", "score"))


@q("mask_resized", f"WITH {_BITS} px AS (SELECT vec_id, R * (3 + vec_id % 19) + C AS p, (3 + vec_id % 19) * (2 + vec_id % 13) AS n FROM (SELECT vec_id, CAST(a.i AS BIGINT) AS R, CAST(b.i AS BIGINT) AS C FROM (SELECT DISTINCT vec_id FROM bits), range(14) a(i), range(21) b(i) WHERE a.i < 2 + vec_id % 13 AND b.i < 3 + vec_id % 19)), v AS (SELECT px.vec_id, px.p, px.n, bits.b FROM px JOIN bits ON bits.vec_id = px.vec_id AND bits.p = ((2 * (px.p // (3 + px.vec_id % 19)) + 1) * 8 // (2 * (2 + px.vec_id % 13))) * 8 + (2 * (px.p % (3 + px.vec_id % 19)) + 1) * 8 // (2 * (3 + px.vec_id % 19))), ch AS (SELECT *, CASE WHEN b = coalesce(lag(b) OVER (PARTITION BY vec_id ORDER BY p), 0) THEN 0 ELSE 1 END AS f FROM v), rn AS (SELECT *, sum(f) OVER (PARTITION BY vec_id ORDER BY p) AS k FROM ch), lens AS (SELECT vec_id, k, count(*) AS n FROM rn GROUP BY 1, 2) SELECT vec_id, CASE WHEN min(k) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS counts FROM lens GROUP BY vec_id")
def _(s, d):
    image = {"tile_h": (2 + F.col("vec_id") % 13).cast("int"), "tile_w": (3 + F.col("vec_id") % 19).cast("int")}
    return masks.resized(mask_rows(s, d).withColumns(image), ["vec_id"]).select("vec_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@q("stitch_max", f"WITH {_BITS} e AS (SELECT 1) SELECT CAST(p // 8 + (vec_id % 3)*6 AS INT) AS r, CAST(p % 8 AS INT) AS c, label AS class, max(score) AS score FROM bits WHERE b = 1 GROUP BY 1, 2, 3")
def _(s, d):
    m = intervals.of_runs(mask_rows(s, d)).withColumns({"row0": ((F.col("vec_id") % 3) * 6).cast("int"), "col0": F.lit(0)})
    return doubles(intervals.pixels(intervals.stitched(m)))


@q("mask_coverage", f"WITH {_BITS} e AS (SELECT 1) SELECT class, CAST(count(*) FILTER (WHERE score > 0.1) AS DOUBLE)/64 AS coverage, max(score) AS top FROM (SELECT label AS class, p, max(score) AS score FROM bits WHERE b = 1 GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return doubles(intervals.coverage(intervals.union(intervals.of_runs(mask_rows(s, d)), ["class"]), 64))


@q("mask_boxes", f"WITH {_BITS} e AS (SELECT 1) SELECT vec_id, CAST(coalesce(min(p % 8) FILTER (WHERE b=1), 0) AS INT) AS x0, CAST(coalesce(min(p // 8) FILTER (WHERE b=1), 0) AS INT) AS y0, CAST(coalesce(max(p % 8) FILTER (WHERE b=1) + 1, 0) AS INT) AS x1, CAST(coalesce(max(p // 8) FILTER (WHERE b=1) + 1, 0) AS INT) AS y1 FROM bits GROUP BY 1")
def _(s, d):
    m = mask_rows(s, d)
    return intervals.boxes(intervals.of_runs(m), m, ["vec_id"])


@q("tile_offsets", "SELECT p_partkey, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS offsets FROM (SELECT DISTINCT p_partkey, o FROM (SELECT p_partkey, unnest(range(0, greatest(t-1024,0)+1, 768)) AS o FROM (SELECT p_partkey, p_size*100 AS t FROM part) UNION ALL SELECT p_partkey, greatest(p_size*100-1024,0) FROM part)) GROUP BY 1")
def _(s, d):
    o = masks.tile_offsets((F.col("p_size") * 100).cast("int"))
    return table(s, d, "part").select("p_partkey", F.array_join(o.cast("array<string>"), ",").alias("offsets"))


def boxes(s, d):
    k = F.col("p_partkey")
    a = [k % 16, (k * 3) % 16, k % 16 + 1 + (k * 5) % 8, (k * 3) % 16 + 1 + (k * 7) % 8]
    b = [(k * 11) % 16, (k * 13) % 16, (k * 11) % 16 + 2, (k * 13) % 16 + 4]
    arr = lambda v: F.array(*[x.cast("double") for x in v])
    return table(s, d, "part").select("p_partkey", arr(a).alias("a"), arr(b).alias("b"))


_BOXES = "bx AS (SELECT p_partkey, k%16 AS a0, (k*3)%16 AS a1, k%16+1+(k*5)%8 AS a2, (k*3)%16+1+(k*7)%8 AS a3, (k*11)%16 AS b0, (k*13)%16 AS b1, (k*11)%16+2 AS b2, (k*13)%16+4 AS b3 FROM (SELECT p_partkey, p_partkey AS k FROM part)),\nio AS (SELECT *, CAST(greatest(least(a2,b2)-greatest(a0,b0),0)*greatest(least(a3,b3)-greatest(a1,b1),0) AS DOUBLE) AS i, CAST((a2-a0)*(a3-a1)+(b2-b0)*(b3-b1) AS DOUBLE) AS s, CAST((greatest(a2,b2)-least(a0,b0))*(greatest(a3,b3)-least(a1,b1)) AS DOUBLE) AS hull FROM bx)"


@q("box_iou", f"WITH {_BOXES} SELECT p_partkey, i/(s-i) AS iou, s-i AS box_union FROM io")
def _(s, d):
    a, b = F.col("a"), F.col("b")
    return boxes(s, d).select("p_partkey", S.box_iou(a, b).alias("iou"), S.box_union(a, b).alias("box_union"))


@q("giou", f"WITH {_BOXES} SELECT p_partkey, i/(s-i) - (hull-(s-i))/hull AS giou FROM io")
def _(s, d):
    return boxes(s, d).select("p_partkey", S.box_giou(F.col("a"), F.col("b")).alias("giou"))


@q("iou_pairs", f"WITH {_BOXES} SELECT x.p_partkey AS k1, y.p_partkey AS k2, greatest(least(x.a2,y.b2)-greatest(x.a0,y.b0),0)*greatest(least(x.a3,y.b3)-greatest(x.a1,y.b1),0)::DOUBLE AS overlap FROM bx x JOIN bx y ON x.p_partkey // 20 = y.p_partkey // 20")
def _(s, d):
    b = boxes(s, d).withColumn("tile", F.expr("p_partkey div 20"))  # boxes meet within their tile only
    o = b.select("tile", F.col("p_partkey").alias("k2"), F.col("b").alias("b2"))
    return b.join(o, "tile").select(F.col("p_partkey").alias("k1"), "k2", S.box_intersection(F.col("a"), F.col("b2")).alias("overlap"))


@q("box_overlaps", f"WITH {_BOXES}, pairs AS (SELECT x.p_partkey // 200 AS tile, x.p_partkey AS k1, y.p_partkey AS k2, CAST(greatest(least(x.a2,y.b2)-greatest(x.a0,y.b0),0)*greatest(least(x.a3,y.b3)-greatest(x.a1,y.b1),0) AS DOUBLE) AS overlap FROM bx x JOIN bx y ON x.p_partkey // 200 = y.p_partkey // 200) SELECT * FROM pairs WHERE overlap > 0")
def _(s, d):
    b = boxes(s, d).withColumn("tile", F.expr("p_partkey div 200"))
    return boxjoin.overlapping(b, b, ["tile"], ("p_partkey", "p_partkey"), ("a", "b"))


@q("box_convert", f"WITH {_BOXES} SELECT p_partkey, (a0+a2)/2.0::DOUBLE AS cx, (a1+a3)/2.0::DOUBLE AS cy, CAST(a2-a0 AS DOUBLE) AS w, CAST(a3-a1 AS DOUBLE) AS h, CAST((a2-a0)*(a3-a1) AS DOUBLE) AS area, CAST(a0 AS DOUBLE)/32 AS nx FROM io")
def _(s, d):
    c = S.xyxy_to_cxcywh(F.col("a"))
    back = S.cxcywh_to_xyxy(c)
    names = ["cx", "cy", "w", "h"]
    return boxes(s, d).select("p_partkey", *[F.get(c, i).alias(n) for i, n in enumerate(names)], S.box_area(back).alias("area"), F.get(S.normalise_box(back, F.lit(32.0), F.lit(32.0)), 0).alias("nx"))


@q("overlap_protected", f"WITH {_BOXES} SELECT p_partkey, greatest(a0,4) < least(a2,12) AND greatest(a1,4) < least(a3,12) AS overlaps, 0 <= a0 AND 0 <= a1 AND a2 <= 16 AND a3 <= 16 AS contained FROM io")
def _(s, d):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    return boxes(s, d).select("p_partkey", S.rectangles_overlap(F.col("a"), box(4, 4, 12, 12)).alias("overlaps"), S.rectangle_contains(box(0, 0, 16, 16), F.col("a")).alias("contained"))


@q("large_boxes", f"WITH {_BOXES} SELECT p_partkey FROM io WHERE NOT (CAST((a2-a0)*(a3-a1) AS DOUBLE) > 0.8::DOUBLE*6*5)")
def _(s, d):
    return masks.drop_large_boxes(boxes(s, d).select("p_partkey", F.col("a").alias("bbox"), F.lit(6).alias("h"), F.lit(5).alias("w"))).select("p_partkey")


# --- selection and tables


def candidates(s, d):
    return table(s, d, "supplier").select(F.col("s_name").alias("name"), (F.floor(F.col("s_acctbal") / 1000) / 16).alias("loss"), (F.col("s_suppkey") % 2).cast("int").alias("learned"), (F.col("s_suppkey") % 4).cast("int").alias("stages"), (F.col("s_suppkey") % 8).cast("double").alias("seconds"))


@q("select_min_loss", "WITH c AS (SELECT s_name AS name, floor(s_acctbal/1000)/16 AS loss, CAST(s_suppkey%2 AS INT) AS learned, CAST(s_suppkey%4 AS INT) AS stages, CAST(s_suppkey%8 AS DOUBLE) AS seconds FROM supplier) SELECT * FROM c WHERE abs(loss-(SELECT min(loss) FROM c)) <= 1e-12 ORDER BY learned, stages, seconds, name LIMIT 1")
def _(s, d):
    return metrics.select_best(candidates(s, d))


@q("config_product", _sql("SELECT s || CASE c WHEN 1 THEN '_c1' ELSE '_c0' END || CASE m WHEN 1 THEN '_s1' ELSE '_s0' END || '_' || t AS name, CAST(3 + c + m + CASE WHEN t = 'naive' THEN 0 ELSE 1 END AS INT) AS stages, code, n FROM (VALUES ('rules'), ('neural')) a(s), (VALUES (0), (1)) b(c), (VALUES (0), (1)) e(m), (VALUES ('naive'), ('height_aware')) f(t), (SELECT classification AS code, count(*) AS n FROM pts GROUP BY 1)"))
def _(s, d):
    rows = [(c.name, int(c.stages)) for c in experiments.configurations()[2:18]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("stages")) for n, k in rows])).alias("x")
    return audit.class_histogram(pts(s, d)).select("code", "n", each).select("x.name", "x.stages", "code", "n")


def results(s, d):
    k = F.col("l_orderkey")
    return table(s, d, "lineitem").groupBy((k % 2 == 0).alias("constraints"), (k % 3 == 0).alias("smoothing"), F.when(k % 5 == 0, "naive").otherwise("height_aware").alias("transfer"), F.when(F.col("l_linenumber") % 2 == 0, "rules").otherwise("neural").alias("source")).agg(F.count(F.lit(1)).cast("double").alias("loss"))


@q("paired_contrast", "WITH r AS (SELECT l_orderkey%2=0 AS constraints, l_orderkey%3=0 AS smoothing, CASE WHEN l_orderkey%5=0 THEN 'naive' ELSE 'height_aware' END AS transfer, l_linenumber%2=0 AS rules, CAST(count(*) AS DOUBLE) AS loss FROM lineitem GROUP BY 1,2,3,4) SELECT a.constraints, a.smoothing, a.transfer, a.loss AS rules_loss, b.loss AS neural_loss, b.loss-a.loss AS difference FROM r a JOIN r b ON a.constraints=b.constraints AND a.smoothing=b.smoothing AND a.transfer=b.transfer AND a.rules AND NOT b.rules")
def _(s, d):
    return metrics.paired_contrast(results(s, d))


@q("tidy_per_class", _sql(f"SELECT 'rules' AS method, 'pilot' AS \"group\", 'all' AS subset, code AS reference, support, tp AS true_positive, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE)/support*100 END AS recall_percent, {_IOU}*100 AS iou_percent FROM {_class_rows()}", _PRED, _OUT))
def _(s, d):
    t = metrics.tidy_per_class(metrics.per_class(metrics.confusion_strict(scored(s, d))), "rules", "pilot", "all")
    return t.select("method", "group", "subset", "reference", "support", "true_positive", "recall_percent", "iou_percent")


#: Confidences of the detector, and of its variants with other limits on boxes, as formulas of the cell.
SHIFTS = {"neural": 0, "neural_0.5": 5, "neural_1": 9}


def _matrix_sql() -> str:
    """Every configuration on its own, from the definitions."""
    conf_of = lambda k: ", ".join(f"CAST(CAST((r*31+c*17+{i}*13+{k})%17 AS FLOAT)/16 AS FLOAT) AS {n}" for n, i in IDS.items())
    sources = {"rules": "SELECT *, " + ", ".join(f"CAST(({_RULE}) = {i} AS FLOAT) AS {n}" for n, i in IDS.items()) + " FROM grd"} | {n: f"SELECT *, {conf_of(k)} FROM grd" for n, k in SHIFTS.items()}
    parts = []
    for c in experiments.configurations():
        if c.pointwise:
            label = _RULE if c.pointwise == "rules" else f"CASE WHEN coalesce(hag > {_f(6)}, false) THEN 4 WHEN coalesce(hag < {_f(2)}, false) THEN 3 ELSE -1 END"
            body = f"SELECT classification AS ref, {_las(f'({label})')} AS pred FROM pth"
        else:
            source = c.source if c.box_fraction is None else f"{c.source}_{c.box_fraction:g}"
            f = c.fusion
            body = f"WITH conf AS ({sources[source]}), {_fused(f.constraints, f.smoothing, f.window, f.tree_height_check, f.physical_smoothing)}{_transfer(c.band or 3.0, c.mode == 'naive')}z AS (SELECT 1) SELECT classification AS ref, {_las('internal_class_id')} AS pred FROM sent"
        parts.append(f"SELECT '{c.name}' AS method, ref AS reference, CASE WHEN pred IN (3,5,6,11,64) THEN CAST(pred AS VARCHAR) WHEN pred = 1 THEN 'unlabelled' ELSE 'invalid' END AS prediction, count(*) AS count FROM ({body}) WHERE ref IN (3,5,6,11,64) GROUP BY 1, 2, 3")
    return _sql(" UNION ALL ".join(parts))


@q("component_matrix", _matrix_sql())
def _(s, d):
    confidence = lambda k: {n: S.f32(((F.col("r") * 31 + F.col("c") * 17 + i * 13 + k) % 17).cast("float") / 16) for n, i in IDS.items()}
    sources = {"rules": fusion.proposals(fusion.baseline())} | {n: confidence(k) for n, k in SHIFTS.items()}
    return experiments.matrix(pth(s, d).withColumn("ref", F.col("classification")), GRID, (grd(s, d), sources))


@q("big_cell_stats", "SELECT CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 64 AS INT) AS c, count(*) AS n, max(CAST(l_quantity AS FLOAT))::DOUBLE AS surface_z, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 64).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max(S.f32(F.col("l_quantity"))).cast("double").alias("surface_z"), F.sum("l_quantity").alias("total"))


@q("void_distance", _sql("SELECT a.r, a.c, CAST(min((a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c)) AS BIGINT) AS d2 FROM grd a, (SELECT r, c FROM grd WHERE n > 2) b GROUP BY a.r, a.c"))
def _(s, d):
    return inpainting.distances(grd(s, d).select("r", "c", F.when(F.col("n") > 2, F.col("n")).alias("n")), GRID, "n")


# --- without SQL


@q("cloth_ground", None)
def _(s, d):
    from .operators import cloth

    p = pts(s, d).select((F.floor(F.col("x") / 2) * 2).alias("x"), (F.floor(F.col("y") / 2) * 2).alias("y"), "z").groupBy("x", "y").agg(F.min("z").alias("z"))
    return cloth.ground(p)


@q("inpaint", None)
def _(s, d):
    return inpainting.inpaint(grd(s, d).select("r", "c", "red"), GRID, "red")


@q("field_digest", None)
def _(s, d):
    return points.digest(pts(s, d), ["orig_index", "x", "y", "z"])


@q("sample", _sql("SELECT * FROM pts ORDER BY md5('7:' || orig_index), orig_index LIMIT 1000"))
def _(s, d):
    return points.sample(pts(s, d), 1000, 7)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
