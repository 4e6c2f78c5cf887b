"""Licence scans: matching statistics and base places by brute force, spans, pieces, edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellgrove.llm import licenses as L

A = L.Automaton()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(text):
    ws = WORD.findall(fold(text))
    found = [(label, i) for label, phrase in L.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for _, i in found]
    return len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in found}))


def texts(seed=2):
    rng = random.Random(seed)
    filler = ["the", "license", "mit", "apache", "general", "public", "GNU", "of", "software", "word", "x9", "été", "is", "free", "you"]
    long_mit = next(t for _, t in L.TEMPLATES if len(t.split()) > 60)
    out = [" ".join(rng.choice(filler) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(60)]
    out += [" ".join(rng.choice(filler) for _ in range(20)) + ", " + t.upper() + ".\n" + " ".join(rng.choice(filler) for _ in range(20)) for _, t in L.TEMPLATES]
    out += [long_mit.replace("sublicense", "rent and or loan"), "MIT-License mit_license MIT\x00LICENSE mitlicense", "", " \n", "mit license mit license", "general public license general public license public license"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_by_brute_force(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4)]
    templates = [(f"t{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(2, 25)))) for k in range(6)]
    a = L.Automaton([], templates, long=3)
    sequences = [t.split() for _, t in templates]
    factors = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.choice([*words, "unknown"]) for _ in range(300)]
    for i, (state, length) in enumerate(a.statistics([a.ids.get(w.encode(), 0) for w in text])):
        want = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in factors), default=0)
        assert length == want
        if length >= 3:
            factor = text[i + 1 - length : i + 1]
            assert a.ends[state] == sorted((t, j + length) for t, s in enumerate(sequences) for j in range(len(s)) if s[j : j + length] == factor)
        assert set(a.stops[state]) == {t for t, s in enumerate(sequences) if a.length[state] >= len(s) and state and _suffix(a, state, sequences, s)}


def _suffix(a, state, sequences, s):
    """Whether s is a suffix of the longest factor of a state, found by walking its words."""
    for q in sequences:
        for i in range(len(q)):
            at = 0
            for j in range(i, len(q)):
                at = a.step[at][a.ids[q[j].encode()]]
                if at == state and j + 1 - i == a.length[state]:
                    return q[j + 1 - len(s) : j + 1] == s
    raise AssertionError


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_scans_by_brute_force_in_any_pieces(piece):
    for t in texts():
        s, n = L.scan(t.encode(), A, piece), brute(t)
        starts = [i for _, i in s.places]
        assert (s.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({A.labels[k] for k, _ in s.places}))) == n
        assert s == L.scan(t.encode(), A)


def test_right_maximal_matches_are_all_found():
    for t in texts(5):
        ws = [A.ids.get(w, 0) for w in L.words_of(t.encode())]
        at, want = [*A.statistics(ws), (0, 0)], []
        want = [(i + 1 - n, n, s) for i, (s, n) in enumerate(at[:-1]) if n >= A.least and at[i + 1][1] <= n]
        for piece in (5, 1 << 20):
            r = L.Reader(A)
            for p in L.pieces(t.encode(), piece):
                if p:
                    r.feed(p)
            r.end()
            assert r.matches == want


def test_spans():
    of = lambda t: {(s.label, s.first, s.last) for s in L.scan(t.encode(), A).spans}
    for label, t in L.TEMPLATES:
        n = len(t.split())
        assert (label, 2, n + 1) in of(f"zz yy {t} zz"), label
    long_mit = next(t for _, t in L.TEMPLATES if len(t.split()) > 60).split()
    changed = [*long_mit[:20], "really", *long_mit[20:40], *long_mit[43:]]  # a word more, three fewer
    assert ("mit", 0, len(changed) - 1) in of(" ".join(changed))
    assert of(" ".join(long_mit[:12])) == set()  # too little of it
    assert of("the software is free and you can use it under the terms of the contract") == set()
    twice = of(" ".join(long_mit + ["zz"] * 9 + long_mit))
    assert ("mit", 0, len(long_mit) - 1) in twice and ("mit", len(long_mit) + 9, 2 * len(long_mit) + 8) in twice


def test_long_repetitive_texts_stay_linear():
    long_mit = next(t for _, t in L.TEMPLATES if len(t.split()) > 60)
    s = L.scan(((long_mit + " and ") * 3000).encode(), A)
    assert len([x for x in s.spans if x.label == "mit"]) == 3000
    s = L.scan(("general public license " * 40_000).encode(), A)
    assert len(s.places) == 40_000


def test_templates_need_two_words():
    with pytest.raises(ValueError):
        L.Automaton([("x", "one")], [])


def test_scan_texts_and_edges(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, None), (None, "the MIT License"), (None, None), (3, "The MIT License."), (3, "The MIT License.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "spans": F.lit(0), "t": F.lit(None).cast("int")}).repartition(4)
    got = L.summary(L.scan_texts(d)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted([(i, *brute(t or "")) for i, t in rows], key=key)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 0) == (r.labels == "") and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    assert L.scan_texts(d.where("false")).collect() == []
