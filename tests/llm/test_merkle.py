"""The Merkle manifest against a plain recomputation of trees, proofs and tampered folds."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cellgrove.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    """(left, right) siblings of node i, level by level."""
    out = []
    for nodes in levels[:-1]:
        run, k = nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        out.append(("".join(run[:k]), "".join(run[k + 1 :])))
        i //= 8
    return out


def brute(rows):
    by: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        fields = (doc_id, source, lang, n_chars)
        good = leaf(*fields, text)
        tampered = good
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            tampered = leaf(*fields, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        by.setdefault(lang, []).append((doc_id, good, tampered))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for v in by.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {x: tree([leaf for _, leaf, _ in by[x]]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for g, x in enumerate(order):
        for i, (doc_id, good, tampered) in enumerate(by[x]):
            steps = path(trees[x], i) + path(top, g)
            folded = tampered
            for left, right in steps:
                folded = h(left, folded, right)
            proof = "".join(a + b for a, b in steps)
            out.append((doc_id, good, trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def run(spark, rows, parts=4):
    d = spark.createDataFrame(rows, DOCS).withColumns({"grp": F.lit("clash"), "pos": F.lit(1), "leaf": F.lit(None).cast("string")}).repartition(parts)
    got = [tuple(r) for r in merkle.manifest(d).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(got, key=key), sorted(brute(rows), key=key)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9}, {"en": 65, "de": 1, None: 3}, {"en": 130, "": 7, "é": 2, "z": 8, None: 64}, {f"l{i:02d}": 1 + i % 3 for i in range(20)}])
def test_manifest_by_brute_force(spark, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 7
            rows.append((i * 31 % 1009, f"Text {i} ÀB\n" if i % 5 else None, lang, "s" if i % 3 else None, i if i % 4 else None))
    got, want = run(spark, rows)
    assert got == want and len({r[3] for r in got}) == 1


def test_manifest_edges(spark):
    """Repeated rows, equal and null doc_ids, empty texts: a place each."""
    rows = [(5, "A", "en", None, 1)] * 20 + [(5, "b", "en", None, 1), (None, "C", "en", None, 1), (None, "C", "en", None, 1), (None, None, None, None, None), (9, "", "en", "", 0)]
    got, want = run(spark, rows, 7)
    assert got == want
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_any_change_breaks_its_proof(spark):
    rows = [(i, f"Upper {i}" if i % 2 else f"lower {i}", "en", "s", 3) for i in range(60)]
    got, _ = run(spark, rows)
    hit = lambda i: zlib.crc32(str(i).encode()) % 3 == 0
    assert {r[0] for r in got if not r[6]} == {i for i in range(60) if hit(i) and i % 2}
