"""Merkle dataset manifest: a tree of digests for each language and one over the languages, with proofs for every row.

Levels are built by slot pivots: conditional aggregates spread the children of a parent into FANOUT columns, whose
concatenation is hashed; all columns but a child's own are its siblings. Proofs go from the top down: each parent hands
its children its own proof behind their siblings, so every level is joined once, with an eighth of the rows below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

FANOUT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of fields, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return digest(*[field(v.cast("string")) for v in values])


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the dense place from 0 in its grp by the order (nulls first), and n, the rows of the grp.

    nodes is a settled table. Ranges of (grp, order) are sorted side by side; only their counts by grp meet. Rows equal
    in all of the order are split by their place in the table, so no range outgrows a task.
    """
    keys = ["grp", *order, "_row"]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = settle(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()))  # ranges are sampled: cut once
    part = F.shiftright("_at", 33)
    totals = at.groupBy("grp", part.alias("_part")).agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_first"))
    w = Window.partitionBy("grp").orderBy("_part")  # a row for each range at most
    before = totals.select("grp", "_part", "_first", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    joined = at.withColumn("_part", part).join(before, ["grp", "_part"])
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _slots() -> list[str]:
    return [f"s{k}" for k in range(FANOUT)]


def level_above(nodes: DataFrame) -> DataFrame:
    """The parents (grp, pos, n, digest, s0 .. s7) of nodes (grp, pos, n, node: a struct with digest)."""
    slots = [F.max(F.when(F.col("pos") % FANOUT == k, F.col("node"))).alias(s) for k, s in enumerate(_slots())]
    d = nodes.groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("_p")).agg(F.max("n").alias("_n"), *slots)
    joined = digest(*[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in _slots()])
    return d.select("grp", F.col("_p").alias("pos"), F.ceil(F.col("_n") / FANOUT).alias("n"), joined.alias("digest"), *_slots())


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The settled levels above placed leaves (grp, pos, n, node), and the root (grp, digest) of each grp; a lone leaf is its root."""
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    levels, roots, below = [], leaves.where("n = 1").select("grp", "node.digest"), leaves
    while most > 1:
        levels.append(settle(level_above(below.where("n > 1"))))
        roots = roots.unionByName(levels[-1].where("n = 1").select("grp", "digest"))
        below, most = levels[-1].select("grp", "pos", "n", F.struct("digest").alias("node")), -(-most // FANOUT)
    return levels, roots


def _children(parents: DataFrame, carried: list[str]) -> DataFrame:
    """grp, pos, node, path of every child: its siblings to the left and right go before its parent's path."""
    part = lambda names: F.concat(F.lit(""), *[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in names])
    each = [F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("node"), part(_slots()[:k]).alias("l"), part(_slots()[k + 1 :]).alias("r")) for k, s in enumerate(_slots())]
    d = parents.select("grp", "path", *carried, F.explode(F.filter(F.array(*each), lambda x: x["node"].isNotNull())).alias("c"))
    return d.select("grp", "c.pos", "c.node", F.concat(F.array(F.struct("c.l", "c.r")), "path").alias("path"), *carried)


def proofs(levels: list[DataFrame], leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """Each leaf's node with its path (siblings to the left and right, level by level) up to its root and on along the
    root's own path; tops: grp, path and columns that all leaves of the grp get."""
    carried, down = [c for c in tops.columns if c not in ("grp", "path")], None
    for level in reversed(levels):
        own = level.where("n = 1").join(tops, "grp")
        if down is not None:
            own = own.unionByName(level.where("n > 1").join(down.drop("node"), ["grp", "pos"]))
        down = _children(own, carried)
    alone = leaves.where("n = 1").join(tops, "grp").select("grp", "pos", "node", "path", *carried)
    return alone if down is None else down.unionByName(alone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, x: digest(x["l"], acc, x["r"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings of all levels), folded_root, verified for every row.

    A row's leaf digests doc_id, source, lang, n_chars and text. Leaves ascend by doc_id within their lang, subroots by
    lang; null comes first in both. Equal doc_ids go by leaf; of rows equal in all five columns each has a place of its
    own. folded_root is recomputed from the row as it would be tampered with: where 3 divides the crc32 of the decimal
    doc_id, the text's A-Z are lower-cased (a null text or doc_id is left alone). Empty texts are fields of 0 bytes. An
    empty table gives no rows. Further columns are ignored. A text is hashed where it is read; only digests travel.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    fields = {c: F.col(c) for c in names}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = leaf_digest(*(fields | {"text": F.translate("text", _UPPER, _LOWER)}).values())
    grp = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))  # null before all, then bytewise
    rows = settle(docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*fields.values()).alias("leaf"), F.when(hit, lowered).alias("tampered")))
    node = F.struct(F.col("leaf").alias("digest"), "doc_id", "tampered")
    leaves = settle(placed(rows, ["doc_id", "leaf"]).select("grp", "pos", "n", node.alias("node")))
    levels, subroots = build(leaves)

    subroots = settle(subroots.select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("of")))
    upper = settle(placed(subroots, ["of"]).select("grp", "pos", "n", F.struct("digest", "of").alias("node")))
    upper_levels, root = build(upper)
    empty = F.array().cast("array<struct<l:string,r:string>>")
    top = proofs(upper_levels, upper, root.select("grp", empty.alias("path"), F.col("digest").alias("root")))
    tops = settle(top.select(F.col("node.of").alias("grp"), "path", F.col("node.digest").alias("subroot"), "root"))

    d = proofs(levels, leaves, tops)
    folded = fold(F.coalesce("node.tampered", "node.digest"), F.col("path"))
    proof = F.flatten(F.transform("path", lambda x: F.array(x["l"], x["r"])))
    d = d.select(F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", "root", F.array_join(proof, "").alias("proof"), folded.alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(levels: int = 7, lang_levels: int = 4) -> str:
    """The manifest's digest columns in DuckDB's SQL, for at most FANOUT ** levels rows of a language."""
    k = FANOUT
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = f"flatten(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS UBIGINT){', 0' * 7}]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bits}), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"
    above = lambda new, old: f"{new} AS (SELECT g, pos // {k} AS pos, (min(n) + {k - 1}) // {k} AS n, min(n) = 1 AS top, list(h ORDER BY pos) AS hs, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {old} GROUP BY g, pos // {k})"
    left, right = f"array_to_string(hs[1:CAST(d.pos % {k} AS BIGINT)], '')", f"array_to_string(hs[CAST(d.pos % {k} AS BIGINT) + 2:], '')"
    walk = lambda new, old, level: f"{new} AS (SELECT doc_id, leaf, lang, d.g, d.pos // {k} AS pos, p.h, CASE WHEN top THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN top THEN proof ELSE proof || {left} || {right} END AS proof FROM {old} d JOIN {level} p ON p.g = d.g AND p.pos = d.pos // {k})"
    parts = [
        f"docs AS (SELECT doc_id, lang, coalesce('+' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f'translate(text, {_UPPER!r}, {_LOWER!r})')} END AS bad FROM documents)",
        "l0 AS (SELECT doc_id, lang, g, leaf, leaf AS h, bad, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs)",
        *[above(f"l{i + 1}", f"l{i}") for i in range(levels)],
        f"t0 AS (SELECT g AS of, 0 AS g, h, row_number() OVER (ORDER BY l{levels}.g) - 1 AS pos, count(*) OVER () AS n FROM l{levels})",
        *[above(f"t{i + 1}", f"t{i}") for i in range(lang_levels)],
        "d0 AS (SELECT doc_id, leaf, lang, g, pos, coalesce(bad, leaf) AS f, '' AS proof FROM l0)",
        *[walk(f"d{i + 1}", f"d{i}", f"l{i + 1}") for i in range(levels)],
        f"e0 AS (SELECT doc_id, leaf, d.h AS lang, 0 AS g, t0.pos, f, proof FROM d{levels} d JOIN t0 ON t0.of = d.g)",
        *[walk(f"e{i + 1}", f"e{i}", f"t{i + 1}") for i in range(lang_levels)],
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, lang AS subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM e{lang_levels}"
