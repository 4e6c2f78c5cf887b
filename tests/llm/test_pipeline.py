"""The pipeline's stages on small tables: brute force, nulls, ties, repeated rows, long and empty texts, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrove.llm import decontaminate, minhash, mixing, quality, secrets
from cellgrove.llm.common import keyed, read

from .test_operators import DOCS, prose

CLASH = ["score", "_h", "_id", "_pieces", "_path", "id", "doc", "gone", "again", "row", "found", "pieces", "kept", "component_id", "contaminated", "size", "taken", "target", "shard", "secret", "of", "v"]
SECRET = "token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark: copies, leaks, secrets, junk, odd rows, and columns that clash."""
    rng, out = random.Random(31), str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 14, 10**6)) for i in range(5)]
    texts = [prose(rng, rng.choice([30, 60]), 10**6) for _ in range(120)]
    texts += [texts[3], texts[4] + " one more", " ".join(texts[5].split()[1:]), texts[3]]
    texts += [prose(rng, 12) + " " + items[k][1].upper() + ", " + prose(rng, 9) for k in (0, 1, 1)]
    texts += [f"{prose(rng, 20, 10**6)} {SECRET} {prose(rng, 5)}", prose(rng, 30_000, 10**6), "", None, " ", "x"]
    junk = ["!! ".join(prose(rng, 50).upper().split()) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts + junk)]
    rows += [(None, texts[7], "en", "s0", 0), (None, texts[7], "en", "s0", 0), (None, items[2][1], "en", "s0", 0), (9, texts[9], "en", "s0", 0), (10, "words " + items[3][1], "en", "s1", 0), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in CLASH})
    d.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items + [(None, "nothing")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 0 if t in junk else 1, 0) for i, t in enumerate(texts + junk) if t and i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_ids_become_unique(spark, tables):
    d = read(spark, tables[0], "documents")
    rows = keyed(d).select("id", "doc.doc_id", "doc.text").collect()
    assert len({r.id for r in rows}) == len(rows) == len(tables[1]) and None not in {r.id for r in rows}
    assert all(r.id == r.doc_id for r in rows if r.doc_id not in (None, 9, 10))


def test_each_stage(spark, tables):
    """Every stage against the definition of its operator, on all that the stage before it kept."""
    out, rows = tables
    d = read(spark, out, "documents")
    names = d.columns
    good = corpus_pipeline.keep_quality(spark, d, out)
    model = quality.fit(d, read(spark, out, "labels"))
    want = [(i, t) for i, t, *_ in rows if model.score(quality.features([(t or "").encode()]))[0] >= quality.THRESHOLD]
    assert good.columns == names and plain(good) == sorted(want, key=str) and len(rows) - 75 < len(want) < len(rows) - 40
    alone = corpus_pipeline.drop_near_duplicates(spark, d, out)
    unique = [(k, t) for k, (_, t, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is None or r[0] in (9, 10), r[0] or 0)))]
    groups = minhash.brute_force(unique, 5)
    got = plain(alone)
    assert alone.columns == names and len(got) == sum(groups[k][1] == k for k, _ in unique)
    assert (120, rows[3][1]) not in got and (3, rows[3][1]) in got and len([t for _, t in got if t == rows[7][1]]) == 1 and len([t for _, t in got if t == rows[9][1]]) == 1
    clean = corpus_pipeline.drop_contaminated(spark, d, out)
    items = [(r.item_id, r.text) for r in read(spark, out, "benchmark").where("item_id is not null").collect()]
    hit = decontaminate.brute_force([(k, r[1]) for k, r in enumerate(rows)], items)
    assert clean.columns == names and plain(clean) == sorted([(r[0], r[1]) for k, r in enumerate(rows) if not hit[k][1]], key=str)
    assert sum(v[1] > 0 for v in hit.values()) == 5
    hidden = corpus_pipeline.redact_secrets(spark, d, out)
    assert hidden.columns == names and plain(hidden) == sorted([(r[0], r[1] and r[1].replace(SECRET, "[SECRET]")) for r in rows], key=str)
    mixed = corpus_pipeline.mix_sources(spark, d, out).collect()
    assert sorted(r["size"] for r in mixed) == sorted(len((r[1] or "").split()) for r in rows) and all(0 <= r.taken <= 3 * r["size"] for r in mixed)


def test_stages_on_an_empty_table(spark, tables):
    d = read(spark, tables[0], "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, tables[0])
        assert got.count() == 0 and (name == "mixing sources" or got.columns == d.columns)


def test_run_is_its_stages_one_after_the_other(spark, tables):
    out, rows = tables
    got = sorted(((r.doc_id, r.source, r["size"], r.taken) for r in corpus_pipeline.run(spark, out).collect()), key=str)
    d = read(spark, out, "documents")
    model = quality.fit(d, read(spark, out, "labels"))
    left = [r for r in rows if model.score(quality.features([(r[1] or "").encode()]))[0] >= quality.THRESHOLD]
    left.sort(key=lambda r: (r[0] is None or sum(x[0] == r[0] for x in left) > 1, r[0] or 0))
    groups = minhash.brute_force([(k, r[1]) for k, r in enumerate(left)], 5)
    left = [r for k, r in enumerate(left) if groups[k][1] == k]
    items = [(r.item_id, r.text) for r in read(spark, out, "benchmark").where("item_id is not null").collect()]
    hit = decontaminate.brute_force([(k, r[1]) for k, r in enumerate(left)], items)
    left = [(r[0], r[1] and r[1].replace(SECRET, "[SECRET]"), r[2], r[3], r[4]) for k, r in enumerate(left) if not hit[k][1]]
    want = sorted(((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(spark.createDataFrame(left, DOCS)).collect()), key=str)
    assert got == want and len(got) > 100
