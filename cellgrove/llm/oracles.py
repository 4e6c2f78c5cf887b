"""The queries that SQL can express, from their definitions, for DuckDB."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _runs(length: int) -> str:
    """Runs (doc_id, b, e) of what repeated starts (table dup: doc_id, i) of a length cover."""
    return f"""steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS f FROM dup),
marked AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps),
runs AS (SELECT doc_id, min(i) AS b, max(i) + {length} AS e FROM marked GROUP BY doc_id, g),
cuts AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p, b FROM runs UNION ALL SELECT d.doc_id, coalesce(max(e), 0), max(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
"""


OP2 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS n FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, n - 19)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM w) WHERE o > 1),
{_runs(20)}
kept AS (SELECT doc_id, flatten(list(ws[p + 1:b] ORDER BY p)) AS ws FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept.ws) AS BIGINT) AS n_removed, sha256(array_to_string(kept.ws, ' ')) AS kept_sha256 FROM d JOIN kept USING (doc_id)"""

OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, CASE len(ws) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE len(ws) - 1 END)) AS i FROM d)),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id, min(y) = n.doc_id AS kept FROM n JOIN reach ON reach.x = n.doc_id GROUP BY n.doc_id, n.n"""

OP5 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM w) WHERE o > 1),
{_runs(100)}
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY p, b) AS h, count(*) - 1 AS spans FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - length(kept.h) // 2 AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (doc_id)"""

_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_TERMS}') AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(len(ws), 10) AS l FROM (SELECT item_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_TERMS}') AS ws FROM benchmark) WHERE len(ws) > 0),
q AS (SELECT DISTINCT item, l, array_to_string(ws[i + 1:i + l], ' ') AS k FROM (SELECT item, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM items)),
w AS (SELECT doc_id, i, l, array_to_string(ws[i + 1:i + l], ' ') AS k FROM (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM items))),
found AS (SELECT doc_id, i, w.l, item FROM w JOIN q ON w.k = q.k AND w.l = q.l),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP10 = """WITH asked AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g FROM conversations WHERE role = 'user'),
chain AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, g ORDER BY turn) - 1 AS level, conv_id || ':' || turn AS call_id FROM asked),
said AS (SELECT c.*, a.text AS result, a.turn IS NOT NULL AS answered FROM chain c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant')
SELECT conv_id, turn, call_id, level, CASE WHEN text IS NULL THEN 'invalid_arguments' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
'{"arguments":' || CASE WHEN text IS NULL THEN '{}' ELSE CAST(to_json({'prompt': text}) AS VARCHAR) END || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"level":' || level || ',"name":"reply"' || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || CAST(to_json(result) AS VARCHAR) END || '}' AS record FROM said"""
