"""Driver queries of sources, alignment, sampling and records, each with its SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import masks, matching, metrics, points, stencil
from .operators.grid import Grid
from .queries import _OUT, _PRED, GRID, _sql, boxes, grd, ptx, pts, scored, table
from .plans import experiments
from .sources import sinks, tiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str):
    def add(f):
        QUERIES[f"q_{name}"], SQL[f"q_{name}"] = f, sql
        return f

    return add


# --- sources and sinks


@q("limited_scan", _sql("SELECT orig_index, x, y, z FROM pts WHERE orig_index < 600"))
def _(s, d):
    return points.limited(pts(s, d), 3, 200).select("orig_index", "x", "y", "z")


@q("subset_raw", _sql("SELECT orig_index, CAST(round((x-16)/0.03125) AS INT) AS x_raw, CAST(round((y-8)/0.03125) AS INT) AS y_raw FROM pts WHERE x >= 20 AND x <= 90 AND y >= 30 AND y <= 100"))
def _(s, d):
    raw = lambda c, shift: F.round((F.col(c) - shift) / 0.03125).cast("int")
    p = pts(s, d).withColumns({"x_raw": raw("x", 16), "y_raw": raw("y", 8)})
    return points.crop(p, (20.0, 30.0, 90.0, 100.0)).select("orig_index", "x_raw", "y_raw")


@q("grid_rows", _sql("SELECT r, list(coalesce(n, 0) ORDER BY c) AS counts FROM grd GROUP BY r"))
def _(s, d):
    row = F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"])
    return grd(s, d).groupBy("r").agg(row.alias("counts"))


@q("returns_cast", _sql("SELECT orig_index, CAST(intensity AS FLOAT)::DOUBLE AS intensity, CAST(number_of_returns AS TINYINT)::INT AS number_of_returns FROM pts"))
def _(s, d):
    return pts(s, d).select("orig_index", F.col("intensity").cast("float").cast("double").alias("intensity"), F.col("number_of_returns").cast("tinyint").cast("int").alias("number_of_returns"))




def _cached(s, d, column: str, old: bool):
    """A cached map of detections by prompt: `road` in the old one, `car` in both, of so many detections."""
    key = F.col("p_partkey")
    one = lambda n, score: F.array_repeat(F.struct(F.struct(F.array(F.lit(4)).alias("counts"), F.array(F.lit(2), F.lit(2)).alias("size")).alias("mask_rle"), F.lit(score).alias("score"), F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))).alias("bbox")), n.cast("int"))
    prompts = [F.lit("car"), one(key % 4 if not old else key % 3, 0.25 if old else 0.75)]
    if old:
        prompts += [F.lit("road"), one(key % 3, 0.5)]
    return table(s, d, "part").where(key % 5 > 0 if old else key % 7 > 0).select(F.col("p_partkey").cast("string").alias("path"), F.create_map(*prompts).alias(column))


@q("cache_merge", """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 4 ELSE p_partkey % 3 END AS cars, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 END AS roads,
  CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 4 > 0 THEN 0.75 END WHEN p_partkey % 3 > 0 THEN 0.25 END::DOUBLE AS car_score FROM part WHERE p_partkey % 5 > 0 OR p_partkey % 7 > 0""")
def _(s, d):
    m = tiles.merge_cache(_cached(s, d, "detections", True), _cached(s, d, "detections", False))
    at = lambda k: F.try_element_at("detections", F.lit(k))
    n = lambda k: F.when(at(k).isNotNull(), F.size(at(k)).cast("long"))
    return m.select("path", n("car").alias("cars"), n("road").alias("roads"), F.get(at("car"), 0)["score"].alias("car_score"))


@q("missing_prompts", "SELECT CAST(p_partkey AS VARCHAR) AS path, ['tree'] AS missing FROM part WHERE p_partkey % 5 > 0")
def _(s, d):
    return tiles.missing_prompts(_cached(s, d, "detections", True), ["car", "road", "tree"])


@q("content_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@q("blank_responses", _sql("SELECT orig_index, '' AS label, '' AS reviewer, '' AS notes FROM pts"))
def _(s, d):
    return sinks.blank_responses(pts(s, d), "orig_index", ["label", "reviewer", "notes"])


@q("ordered_digest", _sql("""SELECT sum(n)::BIGINT AS rows, CASE WHEN count(*) = 1 THEN min(v) ELSE sha256(string_agg(v, chr(10) ORDER BY b)) END AS digest FROM (
  SELECT o // 1000 AS b, count(*) AS n, sha256(string_agg(v, chr(10) ORDER BY o)) AS v FROM (SELECT row_number() OVER (ORDER BY orig_index) - 1 AS o, orig_index || ',' || CAST(x AS VARCHAR) || ',' || classification AS v FROM pts) GROUP BY 1)"""))
def _(s, d):
    return points.ordered_digest(pts(s, d), ["orig_index", "x", "classification"], block=1000, flat=True)


# --- detections


_RESPONSES = """SELECT 'tile_r' || (p_partkey*3) || '_c' || p_partkey || '.png' AS path, p_partkey AS k FROM part"""


def _responses(s, d):
    k = F.col("p_partkey")
    one = lambda n: F.format_string('{"mask_rle":{"counts":[%d,1],"size":[1,%d]},"score":0.%d,"bbox":[0,0,%d,1]}', n, n + 1, 5 + n % 4, n + 1)
    json = F.concat(F.lit('{"car":['), one(k), F.lit(","), one(k + 1), F.lit('],"tree":['), F.when(k % 2 == 0, one(k)).otherwise(""), F.lit("]}"))
    return table(s, d, "part").select(F.format_string("tile_r%d_c%d.png", k * 3, k).alias("path"), json.alias("response"))


_DETECTED = f"""det AS (SELECT path AS tile, CAST(3*k AS INT) AS row0, CAST(k AS INT) AS col0, p AS prompt, n FROM (
  SELECT path, k, 'car' AS p, k AS n FROM ({_RESPONSES}) UNION ALL SELECT path, k, 'car', k+1 FROM ({_RESPONSES}) UNION ALL SELECT path, k, 'tree', k FROM ({_RESPONSES}) WHERE k % 2 = 0))"""


@q("parse_responses", f"WITH {_DETECTED} SELECT tile, row0, col0, prompt, CAST(5 + n%4 AS DOUBLE)/10 AS score, [CAST(n AS INT), 1] AS counts, 1 AS h, CAST(n+1 AS INT) AS w FROM det")
def _(s, d):
    return tiles.parse(_responses(s, d)).select("tile", "row0", "col0", "prompt", "score", "counts", "h", "w")


@q("per_prompt", f"WITH {_DETECTED} SELECT tile, prompt, count(*) AS detections FROM det GROUP BY tile, prompt")
def _(s, d):
    return masks.per_prompt(tiles.parse(_responses(s, d)))


@q("fitting_masks", f"WITH {_DETECTED} SELECT tile, prompt, CAST(n AS BIGINT) AS n FROM det WHERE n = col0")
def _(s, d):
    p = tiles.parse(_responses(s, d)).withColumns({"tile_h": F.lit(1), "tile_w": F.col("col0") + 1})
    return masks.fitting(p).select("tile", "prompt", F.get("counts", 0).cast("long").alias("n"))


@q("normalise_box", "SELECT p_partkey, [CAST(k%16 AS DOUBLE)/32, CAST((k*3)%16 AS DOUBLE)/64, CAST(k%16+1+(k*5)%8 AS DOUBLE)/32, CAST((k*3)%16+1+(k*7)%8 AS DOUBLE)/64] AS box FROM (SELECT p_partkey, p_partkey AS k FROM part)")
def _(s, d):
    return boxes(s, d).select("p_partkey", S.normalise_box(F.col("a"), F.lit(32.0), F.lit(64.0)).alias("box"))


@q("detection_score", "SELECT p_partkey, round((1/(1+exp(-(CAST(p_partkey%13 AS DOUBLE)-6)))) * (1/(1+exp(-(CAST(p_partkey%7 AS DOUBLE)-3)))), 9) AS score FROM part")
def _(s, d):
    logit = lambda n: (F.col("p_partkey") % n).cast("double") - (n // 2)
    return table(s, d, "part").select("p_partkey", F.round(S.detection_score(logit(13), logit(7)), 9).alias("score"))


_VALUES = "v AS (SELECT CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c, CAST((a.i*7+b.i*3)%16 AS DOUBLE) AS v FROM range(32) a(i), range(32) b(i))"
_SMALL = Grid(0.0, 0.0, 32.0, 32.0, 1.0, 32, 32)


def _values(s):
    return _SMALL.cells(s).withColumn("v", ((F.col("r") * 7 + F.col("c") * 3) % 16).cast("double"))


@q("grid_sample", f"""WITH {_VALUES}, place AS (SELECT p_partkey AS id, CAST(p_partkey*5 % 140 AS DOUBLE)/4 - 1 AS y, CAST(p_partkey*11 % 280 AS DOUBLE)/8 - 1 AS x FROM part)
SELECT id, sum(coalesce(v, 0) * CASE WHEN a.i = 0 THEN 1-(y-floor(y)) ELSE y-floor(y) END * CASE WHEN b.i = 0 THEN 1-(x-floor(x)) ELSE x-floor(x) END) AS sample FROM place, range(2) a(i), range(2) b(i) LEFT JOIN v ON v.r = floor(y)+a.i AND v.c = floor(x)+b.i GROUP BY id""")
def _(s, d):
    k = F.col("p_partkey")
    at = table(s, d, "part").select(k.alias("id"), ((k * 5 % 140).cast("double") / 4 - 1).alias("y"), ((k * 11 % 280).cast("double") / 8 - 1).alias("x"))
    return stencil.grid_sample(_values(s), _SMALL, at, "v").select("id", "sample")


@q("roi_align", f"""WITH {_VALUES}, b AS (SELECT p_partkey AS box, CAST(p_partkey % 24 AS DOUBLE) AS x0, CAST(p_partkey*3 % 28 AS DOUBLE) AS y0, CAST(p_partkey % 24 + 8 AS DOUBLE) AS x1, CAST(p_partkey*3 % 28 + 16 AS DOUBLE) AS y1 FROM part),
p AS (SELECT box, CAST(i.i AS INT) AS i, CAST(j.i AS INT) AS j, y0-0.5+(i.i+(k.i+0.5)/2)*(y1-y0)/2 AS y, x0-0.5+(j.i+(l.i+0.5)/2)*(x1-x0)/2 AS x, k.i AS k, l.i AS l FROM b, range(2) i(i), range(2) j(i), range(2) k(i), range(2) l(i)),
c AS (SELECT box, i, j, k, l, y BETWEEN -1 AND 32 AND x BETWEEN -1 AND 32 AS ok, least(greatest(y, 0), 31) AS y, least(greatest(x, 0), 31) AS x FROM p),
m AS (SELECT box, i, j, k, l, ok, sum(coalesce(v, 0) * CASE WHEN a.u = 0 THEN 1-(y-floor(y)) ELSE y-floor(y) END * CASE WHEN e.w = 0 THEN 1-(x-floor(x)) ELSE x-floor(x) END) AS s FROM c, range(2) a(u), range(2) e(w) LEFT JOIN v ON v.r = floor(y)+a.u AND v.c = floor(x)+e.w GROUP BY ALL)
SELECT box, i, j, avg(CASE WHEN ok THEN s ELSE 0 END) AS value FROM m GROUP BY box, i, j""")
def _(s, d):
    k = F.col("p_partkey")
    b = table(s, d, "part").select(k.alias("box"), F.array(*[x.cast("double") for x in (k % 24, k * 3 % 28, k % 24 + 8, k * 3 % 28 + 16)]).alias("bbox"))
    return stencil.roi_align(_values(s), _SMALL, b, "v", (2, 2))


# --- alignment, order and records


@q("ordinal_zip", _sql("SELECT a.o AS ordinal, a.orig_index, b.classification FROM (SELECT orig_index, row_number() OVER (ORDER BY orig_index) - 1 AS o FROM pts) a JOIN (SELECT classification, row_number() OVER (ORDER BY orig_index DESC) - 1 AS o FROM pts) b USING (o)"))
def _(s, d):
    p = pts(s, d)
    back = points.ordinal(p.select((-F.col("orig_index")).alias("k"), "classification"), "k").select("ordinal", "classification")
    return points.ordinal(p.select("orig_index")).join(back, "ordinal").select("ordinal", "orig_index", "classification")


@q("sorted_ids", _sql("SELECT orig_index, z, row_number() OVER (ORDER BY orig_index) - 1 AS place FROM pts"))
def _(s, d):
    return points.ordinal(pts(s, d).select("orig_index", "z"), out="place")


@q("first_examples", _sql("SELECT orig_index FROM pts WHERE classification = 64 ORDER BY orig_index LIMIT 5"))
def _(s, d):
    return points.examples(pts(s, d).where("classification = 64").select("orig_index"))


@q("context", _sql("SELECT p.orig_index, p.r, p.c, CAST(p.exg AS DOUBLE) AS exg, CAST(g.surface_z AS DOUBLE) AS surface_z, g.n, CAST(g.hag AS DOUBLE) AS cell_hag FROM ptx p JOIN grd g USING (r, c) WHERE p.x >= 20 AND p.x <= 90 AND p.y >= 30 AND p.y <= 100"))
def _(s, d):
    cells = grd(s, d).select("r", "c", "surface_z", "n", F.col("hag").alias("cell_hag"))
    p = experiments.context(ptx(s, d), GRID, cells, (20.0, 30.0, 90.0, 100.0), closed=True)
    return p.select("orig_index", "r", "c", F.col("exg").cast("double").alias("exg"), F.col("surface_z").cast("double").alias("surface_z"), "n", F.col("cell_hag").cast("double").alias("cell_hag"))


@q("part_coordinates", _sql("SELECT orig_index, x, y, z, CASE WHEN orig_index % 4 = 0 THEN 3 WHEN orig_index % 4 = 1 THEN 5 ELSE 1 END AS classification FROM pts"))
def _(s, d):
    p = pts(s, d).select("orig_index", "x", "y", "z")
    near = p.withColumn("x", F.col("x") + 0.005)
    return matching.merge_parts(p, {3: near.where("orig_index % 4 = 0"), 5: p.where("orig_index % 4 = 1")})


def _losses(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("loss")).select(F.col("p_brand").alias("name"), "loss")


@q("named_pairs", "WITH l AS (SELECT p_brand AS name, CAST(sum(p_size) AS DOUBLE) AS loss FROM part GROUP BY 1) SELECT a.name AS old, b.name AS new, a.loss AS old_loss, b.loss AS new_loss, b.loss - a.loss AS difference FROM l a JOIN l b ON (a.name, b.name) IN (('Brand#11','Brand#12'), ('Brand#13','Brand#21'), ('Brand#none','Brand#22'))")
def _(s, d):
    return metrics.named_pairs(_losses(s, d), {"Brand#11": "Brand#12", "Brand#13": "Brand#21", "Brand#none": "Brand#22"})


@q("same_support", _sql("SELECT count(DISTINCT s) <= 1 AS same FROM (SELECT m, list((ref, n) ORDER BY ref) AS s FROM (SELECT orig_index % 2 AS m, ref, count(*) AS n FROM scored WHERE ref IN (3,5,6,11,64) GROUP BY 1, 2) GROUP BY m)", _PRED, _OUT))
def _(s, d):
    by = scored(s, d).withColumn("method", F.col("orig_index") % 2)
    classes = metrics.per_class(metrics.confusion_strict(by, by=["method"]), by=["method"])
    return s.createDataFrame([(metrics.same_support(classes),)], "same boolean")


@q("tidy_confusion", _sql("SELECT 'rules' AS method, 'pilot' AS \"group\", 'all' AS subset, ref AS reference, prediction, count(*) AS count FROM o GROUP BY ref, prediction", _PRED, _OUT))
def _(s, d):
    return metrics.tidy_confusion(metrics.confusion_strict(scored(s, d)), "rules", "pilot", "all")


@q("recounted", _sql("SELECT code, count(*) FILTER (WHERE ref = code) AS support, count(*) FILTER (WHERE ref = code AND pred = code) AS true_positive, count(*) FILTER (WHERE ref <> code AND pred = code) AS false_positive, count(*) FILTER (WHERE ref = code AND pred <> code) AS false_negative FROM rc, o GROUP BY code", _PRED, _OUT))
def _(s, d):
    return metrics.recounted(scored(s, d))


@q("recount_agrees", _sql("SELECT CAST(0 AS BIGINT) AS disagreements", _PRED))
def _(s, d):
    o = scored(s, d)
    return metrics.disagreements(metrics.per_class(metrics.confusion_strict(o)), metrics.recounted(o)).agg(F.count(F.lit(1)).alias("disagreements"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
