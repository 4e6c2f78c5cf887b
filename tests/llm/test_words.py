"""Words that a polynomial hash modulo 2 ** 64 can't tell apart: no operator may take one for the other."""

import numpy as np
import pytest

from cellgrove.llm import decontaminate, exchange, minhash, substring

DOCS = "doc_id long, text string"


def twins():
    """The Thue-Morse word of 1,024 letters and its complement."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_word_ids_tell_words_apart():
    words = [*(w.encode() for w in twins()), b"a", b"a\x00", b"a\x00\x00", b"\x00", b"", *(bytes([c]) * n for c in (97, 98) for n in range(1, 40)), b"x" * 14 + b"y", b"y" + b"x" * 14]
    words += [f"w{i}".encode() for i in range(20_000)]
    words = [*dict.fromkeys(words)]
    raw = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = end - [len(w) for w in words]
    a, b = exchange.word_ids(raw, begin, end)
    assert len({*zip(a.tolist(), b.tolist())}) == len(words)
    assert len(np.unique(exchange.word_hashes(raw, begin, end))) == len(words)
    again = exchange.word_ids(b"zzz" + raw[begin[5] :], begin[5:] - begin[5] + 3, end[5:] - begin[5] + 3)
    assert (again[0] == a[5:]).all() and (again[1] == b[5:]).all()


@pytest.fixture(scope="module")
def texts():
    common = [f"w{i}" for i in range(19)]
    return [(i, " ".join([*common, w])) for i, w in enumerate(twins(), 1)]


def test_substring_dedup_compares_words(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substring.repeats(spark.createDataFrame(texts, DOCS)).collect()}
    assert got == substring.brute_force(texts) and all(v[1] == 0 for v in got.values())


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_compares_words(spark, width):
    one, other = twins()
    rows = [(1, one), (2, other), (3, f"{one} {one} {other}"), (4, f"{other} {other} {one}")]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width=width).collect()}
    assert got == {i: (i, True) for i in (1, 2, 3, 4)}


def test_decontamination_compares_words(spark, texts):
    items = [(7, texts[0][1])]
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d: v[1] for d, v in decontaminate.brute_force(texts, items).items()} and got[1] == 20 and got[2] == 19
