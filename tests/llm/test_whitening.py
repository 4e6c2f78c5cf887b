"""Whitening against exact integers and numpy, edge cases, and sums of bit planes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed=3, n=400, dims=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) * np.array([4, 3, 2, 1, 0.5, 0.2]) + 40
    v[100:140] = v[7]  # one vector is a tenth of all rows
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]


def expected(rows):
    """By exact integers: usable ids with their integer vectors, fit list, sums, covariance."""
    usable = [(i, tuple(math.floor(c * 256) for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    return usable, fit, n, sums


def check(got, rows):
    usable, fit, n, sums = expected(rows)
    m = np.array(fit, dtype=object) * n - np.array(sums, dtype=object)
    cov = (m.T @ m).astype(float) / float(n) ** 3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, int((values > 1e-10 * values[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in usable for c in range(1, k + 1))
    xs = dict(usable)
    by: dict = {}
    for r in got:
        d = [n * a - s for a, s in zip(xs[r.vec_id], sums)]
        assert (r.n, r.deviation) == (n, sum(v * v for v in d))
        by.setdefault(r.component, []).append((r.whitened, float(np.dot(np.array(d, float) / n, axes[:, r.component - 1]) / math.sqrt(values[r.component - 1]))))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6) and r.identity_error <= 1e-4
    for pairs in by.values():
        a, b = np.array(pairs).T
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)


def test_whitening_by_exact_integers(spark):
    rows = vectors()
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("clash"), "n": F.lit(None).cast("int"), "key": F.lit(1)}).repartition(5)
    check(whitening.whiten(d).collect(), rows)


def test_whitening_edges(spark):
    rows = vectors(n=60)
    rows += [(900, None, 1), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (902, [float("nan")] + [1.0] * 5, 1), (903, [float("inf")] + [1.0] * 5, 1), (904, [-0.0] * 6, None), (905, [1e300] * 6, None)]
    rows += [(906, [], 0), (907, [1.0, 2.0], 0)]  # other lengths
    d = spark.createDataFrame(rows, SCHEMA)
    check(whitening.whiten(d).collect(), [r for r in rows if r[0] < 905])
    again = whitening.whiten(d.unionByName(d.where("vec_id < 3"))).collect()
    assert len(again) == len(whitening.whiten(d).collect()) + 12  # repeated rows come again, the fit list stays
    assert {r.n for r in again} == {61}
    nameless = whitening.whiten(d.withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(nameless) == 61 * 4 and all(r.vec_id is None for r in nameless)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)


@pytest.mark.parametrize("low, high", [(-3, 4), (0, 1), (5, 6), (-(2**40), 2**40), (-(2**62), 2**62)])
def test_scatter_is_exact(low, high):
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        x = rng.integers(low, high, (n, 5), dtype=np.int64)
        products, sums = whitening.scatter(x)
        exact = [[int(v) for v in row] for row in x.tolist()]
        assert sums == [sum(c) for c in zip(*exact)]
        assert products == [[sum(r[i] * r[j] for r in exact) for j in range(5)] for i in range(5)]


def test_large_counts_stay_exact():
    """Deviations and sums beyond a long, as 10 ** 12 rows would give them."""
    m = whitening.Whitener(10**12, (10**15, -(10**15)), 1.0, np.ones(1), np.ones((2, 1)))
    x = np.array([[1000, 7], [2**50, 3]])
    d = m.deviations(x)
    exact = [[10**12 * a - s for a, s in zip(r, m.sums)] for r in x.tolist()]
    assert d.tolist() == exact
    sq = [sum(v * v for v in r) for r in exact]
    assert m.squared(d) == [v if v < 1 << 63 else None for v in sq]


def test_limbs_carry_any_sum():
    for v in (0, -1, 2**100 + 5, -(2**120) - 3, 2**31):
        assert sum(p << (32 * k) for k, p in enumerate(whitening._limbs(v))) == v
