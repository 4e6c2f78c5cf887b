"""Embedding whitening from exact integer covariances: bit-sliced scatter, centred before the eigendecomposition.

Entries become integers (SCALE steps to one). A block of rows is packed by bits: for every dimension and bit of the
values above the block's least one, one bit a row, 64 rows a word. The product sum of two dimensions is then the sum of
2 ** (a + b) * popcount(plane a AND plane b), with no rounding anywhere. Blocks add up over Spark's tasks, entry by entry.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE = 256
COMPONENTS = 4
#: Rows of a block: as many are packed together. Product sums travel as LIMBS numbers of 32 bits, the last one signed.
BLOCK, LIMBS = 8192, 5
_LONG = 1 << 63


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """All rows and columns whose vector has numbers only, with x: the floors of SCALE times its entries, as long.

    Rows go whose vector is null, or holds a null, an entry that isn't finite, or one whose integer no long can hold.
    """
    scaled = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(_LONG), F.lit(False))  # noqa: E731  false for NaN too
    kept = vectors.where(F.col(column).isNotNull() & F.forall(column, fits))
    return kept.withColumn("x", F.transform(scaled, lambda v: v.cast("long")))


def planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """The bit planes of rows x dims of uint64: (dims * bits) rows of 64-bit words, dimension by dimension, lowest bit first."""
    n, dims = y.shape
    bits = max(1, int(y.max(initial=np.uint64(0))).bit_length())
    out = np.zeros((dims * bits, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0).T
        out[b::bits, : packed.shape[1]] = packed
    return out.view(np.uint64), bits


def scatter(x: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """The exact product sums of all pairs of dimensions of rows x dims of int64, and the sums of the dimensions."""
    n, dims = x.shape
    least = x.min(0)
    y = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2 ** 64: the true difference, which is below that
    words, bits = planes(y)
    counts = np.zeros((dims * bits, dims * bits), np.int64)
    for p in range(dims * bits):
        counts[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(1, dtype=np.int64)
    counts = np.triu(counts) + np.triu(counts, 1).T
    exact = np.int64 if 2 * bits + int(n).bit_length() < 62 else object
    weight = np.array([1 << b for b in range(bits)], dtype=exact)
    by = counts.astype(exact).reshape(dims, bits, dims, bits)
    products = ((by * weight).sum(3) * weight[None, :, None]).sum(1)
    sums = (np.diagonal(counts).astype(exact).reshape(dims, bits) * weight).sum(1).tolist()
    low = least.tolist()
    whole = [[int(p) + a * t + b * s + n * a * b for p, b, t in zip(row, low, sums)] for row, a, s in zip(products, low, sums)]
    return whole, [s + n * a for s, a in zip(sums, low)]


def _limbs(v: int) -> list[int]:
    return [(v >> (32 * k)) & 0xFFFFFFFF if k < LIMBS - 1 else v >> (32 * k) for k in range(LIMBS)]


@dataclass(frozen=True)
class Whitener:
    """n, sums: the fit list's size and sums by dimension; axes: unit eigenvectors as columns; values: their variances."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: int64 where that holds them, else Python's integers."""
        most = self.n * max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0))))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < _LONG // 2 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def squared(self, d: np.ndarray) -> list[int | None]:
        """The exact sums of squared deviations; None beyond a long."""
        most = max(map(abs, (int(d.min(initial=0)), int(d.max(initial=0)))))
        e = d if d.dtype != object and d.shape[1] * most * most < _LONG else d.astype(object)
        return [int(v) if v < _LONG else None for v in (e * e).sum(1)]

    def whiten(self, d: np.ndarray) -> np.ndarray:
        return ((d / self.n).astype(float) @ self.axes) / np.sqrt(self.values)


def solve(n: int, products: list[list[int]], sums: list[int], components: int = COMPONENTS) -> Whitener:
    """The leading components of the covariance (n * products - sums x sums) / n ** 2, whose numerator is an integer.

    Components that have no variance (to double precision) can't be whitened and are left out. Of the two signs an axis
    takes the one that makes its largest entry positive.
    """
    dims = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)], dtype=float).reshape(dims, dims)
    values, axes = np.linalg.eigh(v) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-13 * max(values.max(initial=0.0), 0.0)]
    axes = axes[:, order]
    if axes.size:
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitener(n, tuple(sums), float(np.trace(v)), values[order], axes)


def _rows(b: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64, copy=False)


def fit(points: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener:
    """From a settled table of distinct x of one length. The driver gets dims ** 2 / 2 numbers, whatever the rows."""

    def run(batches):
        total, sums, n = None, None, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _rows(b.slice(at, BLOCK), "x", dims)
                p, s = scatter(x)
                p, s = np.array(p, dtype=object), np.array(s, dtype=object)
                total, sums, n = (p, s, n + len(x)) if total is None else (total + p, sums + s, n + len(x))
        if n:
            i, j = np.triu_indices(dims)
            keys = [*zip(i.tolist(), j.tolist()), *((k, -1) for k in range(dims)), (-1, -1)]
            parts = np.array([_limbs(int(v)) for v in [*total[i, j], *sums, n]], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array(parts[:, k]) for k in range(LIMBS))], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    limbs = [f"l{k}" for k in range(LIMBS)]
    blocks = points.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    got = {(r[0], r[1]): sum(v << (32 * k) for k, v in enumerate(r[2:])) for r in blocks.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect()}
    n = got.pop((-1, -1), 0)
    products = [[got.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)]
    return solve(max(n, 1), products, [got.get((k, -1), 0) for k in range(dims)], components)


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each row of usable numbers and each component: key, component, n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct integer vector once, so repeated rows don't weigh. Rows that `integers` drops, and
    vectors of another length than most distinct ones have (of equals the longest), give no rows; repeated rows, and
    rows of one key, give rows each; a null key stays null. Components are numbered by falling variance, up to the
    rank: one distinct vector, or none, gives no rows. deviation is exact, null beyond a long. identity_error is
    measured on the whitened fit list, its mean taken off. Further columns are ignored.
    """
    rows = integers(vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("v")), "v").select("key", "x")
    distinct = settle(rows.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    dims = lengths[0] if lengths else 0
    points = distinct.where(F.size("x") == dims)
    model = fit(points, dims, components)
    spark, k = vectors.sparkSession, len(model.values)
    given = spark.sparkContext.broadcast(model)  # dims ** 2 numbers

    def projected(batches):
        for b in batches:
            w = given.value.whiten(given.value.deviations(_rows(b, "x", dims)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in range(k)], names=[f"w{c}" for c in range(k)])

    worst = None
    if k:
        w = points.select("x").mapInArrow(projected, ", ".join(f"w{c} double" for c in range(k)))
        cov = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)) for i in range(k) for j in range(i, k)]
        worst = w.agg(F.array_max(F.array(*cov))).first()[0]

    def run(batches):
        m = given.value
        for b in batches:
            x = _rows(b, "x", dims)
            d, n = m.deviations(x), len(x)
            w = m.whiten(d)
            at = np.repeat(np.arange(n), k)
            squared = pa.array(m.squared(d), pa.int64())
            columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n, np.int64)), squared.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace, n)), pa.array(np.full(n * k, worst))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    usable = rows.where(F.size("x") == dims) if k else rows.where("false")
    out = usable.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
