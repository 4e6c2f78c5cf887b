"""Quality classifier: Bradley-Terry scores learnt from all preference pairs, cut at a score quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import settle

THRESHOLD = 0.3
#: The loss adds DECAY / 2 times the square of the weights. At most STEPS passes are made over the labelled documents.
DECAY, STEPS = 1e-4, 40
#: Bins of scores for each label, by which all pairs are compared, and runs of bins for second moments.
BINS, BLOCKS = 1024, 32
UNIT = 1 << 20
PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]


_PLACES = np.zeros(256, np.int64)  # the group of each byte: an ASCII sign of its own, or letters, digits, space, others
for _i, _group in enumerate([range(65, 91), range(97, 123), range(48, 58), [32], range(128, 256)]):
    _PLACES[list(_group)] = _i + 1
_PLACES[PUNCTUATION] = 6 + np.arange(len(PUNCTUATION))
GROUPS = 6 + len(PUNCTUATION)
FEATURES = 12 + len(PUNCTUATION)


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: lengths, repetition, and the shares of byte classes and of each ASCII sign in the whole text."""
    if not texts:
        return np.zeros((0, FEATURES))
    lens = np.array([len(t) for t in texts])
    counts = np.stack([np.bincount(_PLACES[np.frombuffer(t, np.uint8)], minlength=GROUPS) for t in texts])
    h = counts / np.maximum(1, lens)[:, None]
    sizes = lambda parts: (len(parts), len(set(parts)))
    # one text's words at a time: a batch of them would fill the worker
    n_words, own_words = np.array([sizes(t.split()) for t in texts]).T
    n_lines, own_lines = np.array([sizes(t.split(b"\n")) for t in texts]).T
    signs = h[:, 6:]
    head = [np.log1p(n_words), np.log1p(lens), own_words / np.maximum(1, n_words), own_lines / n_lines, np.log1p(n_lines), np.maximum(1, lens) / np.maximum(1, n_words) / 10]
    shares = [h[:, 1], h[:, 2], h[:, 3], signs.sum(1), h[:, 5], h[:, 4]]
    return np.column_stack([*head, *shares, np.sqrt(signs)])


def held_out(mod: int) -> Column:
    """Whether mod divides the crc32 of the decimal doc_id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 0, F.lit(False))


class Ranker:
    """score = sigmoid(w . z - cut + logit(THRESHOLD)); z: the standardised features.

    w minimises the Bradley-Terry loss, log(1 + exp(w . (z of the worse - z of the better))), over all pairs of a
    labelled document of quality 1 and one of 0. The cut is the quantile of all labelled documents' scores at the share of
    those labelled 0, so THRESHOLD parts as many as the labels do. z and w are multiples of 1 / UNIT, kept as integers:
    scores and sums are exact and don't depend on the order of rows. Without documents of both labels every score is 0.5.
    """

    def __init__(self, mean: np.ndarray | None = None, spread: np.ndarray | None = None):
        self.fitted, self.mean, self.spread = mean is not None, mean, spread
        self.w, self.cut = np.zeros(FEATURES, np.int64), 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((x - self.mean) / self.spread, -6, 6) * UNIT).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        at = (self.scaled(x) @ self.w - self.cut) / UNIT**2 + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -50, 50)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, FEATURES)


def _labelled(docs: DataFrame, labels: DataFrame, mod: int) -> DataFrame:
    """quality and x (features as bytes) of every labelled document that is not held out; contradictory labels don't count."""
    chosen = labels.where("doc_id is not null and quality is not null").where(~held_out(mod)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_m")).where("quality = _m and quality in (0, 1)").select("doc_id", "quality")

    def run(batches):
        for b in batches:
            x = features([t or b"" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    text = docs.where("doc_id is not null").where(~held_out(mod)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return text.mapInArrow(run, "doc_id long, x binary").join(chosen, "doc_id").select("quality", "x")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many documents are labelled 0 and 1, and the mean and the spread of their features."""

    def run(batches):
        n, sums = np.zeros(2, np.int64), np.zeros((2, FEATURES))
        for b in batches:
            x = _matrix(b.column(1))
            n += np.bincount(b.column(0).to_numpy(), minlength=2)
            sums += [x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([list(map(float, n))]), pa.array([sums.ravel().tolist()])], names=["n", "sums"])

    parts = sorted((r.n, r.sums) for r in rows.mapInArrow(run, "n array<double>, sums array<double>").collect())
    n = np.array([p[0] for p in parts]).reshape(-1, 2).sum(0)
    first, second = np.array([p[1] for p in parts]).reshape(-1, 2, FEATURES).sum(0) / max(1, n.sum())
    coarse = lambda v: v.astype(np.float32).astype(np.float64)  # noqa: E731  rounded, as float sums depend on the order of rows
    return n, coarse(first), coarse(np.sqrt(np.maximum(0, second - first**2)) + 1e-9)


def _binned(rows: DataFrame, model: Ranker, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums over the documents of each label, by bins of their scores.

    For every label and bin: documents, and the sum of their z. For every label and 1 of BLOCKS runs of bins: the sum of
    z z'. A task holds one such table, 2 MB at any size of its input, and the tables are added up by Spark.
    """
    given = rows.sparkSession.sparkContext.broadcast((model, width))

    def run(batches):
        m, step = given.value
        total, squares = np.zeros((2 * BINS, 1 + FEATURES), np.int64), np.zeros((2 * BLOCKS, FEATURES, FEATURES))
        for b in batches:
            if not b.num_rows:
                continue
            z = m.scaled(_matrix(b.column(1)))
            code = b.column(0).to_numpy() * BINS + np.clip(z @ m.w // step + BINS // 2, 0, BINS - 1)
            order = np.argsort(code, kind="stable")
            code, z = code[order], z[order]
            own, starts, counts = np.unique(code, return_index=True, return_counts=True)
            total[own, 0] += counts
            total[own, 1:] += np.add.reduceat(z, starts, axis=0)
            small, block = np.rint(z / (UNIT >> 8)), code // (BINS // BLOCKS)  # whole numbers: float sums of them are exact
            for k, first, count in zip(*np.unique(block, return_index=True, return_counts=True)):
                part = small[first : first + count]
                squares[k] += part.T @ part
        at = np.flatnonzero(total[:, 0])
        lines = np.flatnonzero(squares.any(2).ravel())
        table = np.zeros((len(at) + len(lines), 2 + FEATURES), np.int64)
        table[: len(at), 0], table[: len(at), 1:] = at, total[at]
        table[len(at) :, 0], table[len(at) :, 2:] = 2 * BINS + lines, squares.reshape(-1, FEATURES)[lines]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=names)

    names = ["key", *[f"v{i}" for i in range(1 + FEATURES)]]
    sums = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow()
    key, values = sums.column("key").to_numpy(), np.column_stack([sums.column(n).to_numpy() for n in names[1:]])
    given.unpersist()
    table, squares = np.zeros((2 * BINS, 1 + FEATURES)), np.zeros((2 * BLOCKS * FEATURES, FEATURES))
    table[key[key < 2 * BINS]] = values[key < 2 * BINS]
    squares[key[key >= 2 * BINS] - 2 * BINS] = values[key >= 2 * BINS, 1:]
    table[:, 1:] /= UNIT
    return table.reshape(2, BINS, -1), squares.reshape(2, BLOCKS, FEATURES, FEATURES) / 4**8


def _pairs(table: np.ndarray, squares: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and (by blocks) Hessian of the mean over all pairs of a better and a worse document.

    Pairs of two bins count as often as there are, at the difference of the bins' mean scores.
    """
    (n0, z0), (n1, z1) = ((t[:, 0], t[:, 1:]) for t in table)
    mean = lambda n, z: z @ w / np.maximum(1, n)
    d = mean(n1, z1)[:, None] - mean(n0, z0)[None, :]
    wrong, every = 1 / (1 + np.exp(np.clip(d, -500, 500))), n1.sum() * n0.sum()
    loss = float(n1 @ np.logaddexp(0, -d) @ n0) / every + DECAY / 2 * float(w @ w)
    gradient = ((wrong.T @ n1) @ z0 - (wrong @ n0) @ z1) / every + DECAY * w
    fold = lambda v: v.reshape(BLOCKS, BINS // BLOCKS, -1).sum(1)
    curved = (wrong * (1 - wrong)) * n1[:, None] * n0[None, :]
    m0, m1, s0, s1 = np.maximum(1, fold(n0)), np.maximum(1, fold(n1)), fold(z0), fold(z1)
    c = fold(fold(curved).T).T / m1 / m0.T  # better blocks by worse ones
    cross = s1.T @ c @ s0
    hessian = np.tensordot(c @ fold(n0), squares[1], ([0], [0]))[0] + np.tensordot(c.T @ fold(n1), squares[0], ([0], [0]))[0] - cross - cross.T
    return loss, gradient, hessian / every + DECAY * np.eye(FEATURES)


def _descend(rows: DataFrame, model: Ranker) -> None:
    """Sets w by Newton's steps, halved while they raise the loss; each is one pass over all rows.

    It ends where another step would lower the loss by less than 1 part in 1,000,000. Losses are told apart to 1 part in 1,000 only, as bins shift.
    """
    w, at, least, step, share, width = np.zeros(FEATURES), np.zeros(FEATURES), np.inf, None, 1.0, UNIT**2
    for _ in range(STEPS):
        model.w = np.rint(w * UNIT).astype(np.int64)
        table, squares = _binned(rows, model, width)
        loss, gradient, hessian = _pairs(table, squares, model.w / UNIT)
        if loss <= least * 1.001:
            at, least, step, share = w, loss, -np.linalg.solve(hessian, gradient), 1.0
            if -gradient @ step < 1e-6 * loss:
                return
        else:
            share /= 2
        w = at + share * step
        far = np.abs(table[..., 1:] @ w / np.maximum(1, table[..., 0])).max()
        width = max(1, int((1.5 * far + 1) * UNIT**2) // (BINS // 2))
    model.w = np.rint(at * UNIT).astype(np.int64)


def _ordered(values: DataFrame, k: int) -> tuple[int, int]:
    """The values at places k and k + 1 (from 0) of a column v of whole numbers in ascending order; k + 1 may be past the end.

    Ranges are counted, and the one with place k is taken apart, until it holds a single value.
    """
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    left = k
    while lo < hi:
        width = -(-(hi - lo + 1) // 4096)
        counts = values.where(F.col("v").between(lo, hi)).groupBy(F.expr(f"(v - {lo}L) div {width}L").alias("b")).count().collect()
        for b, n in sorted(tuple(r) for r in counts):
            if left < n:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            left -= n
    upto, above = values.agg(F.count_if(F.col("v") <= lo), F.min(F.when(F.col("v") > lo, F.col("v")))).first()
    return lo, lo if upto > k + 1 or above is None else above


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5) -> Ranker:
    """Fitted on every labelled document that is not held out."""
    rows = settle(_labelled(docs, labels, mod))
    (bad, good), mean, spread = _moments(rows)
    if not bad or not good:
        return Ranker()
    model = Ranker(mean, spread)
    _descend(rows, model)
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(given.value.scaled(_matrix(b.column(1))) @ given.value.w, pa.int64())], names=["v"])

    under, over = _ordered(settle(rows.mapInArrow(run, "v long")), int(bad) - 1)
    model.cut = over - int((over - under) * bad / (bad + good))
    return model


def _rated(docs: DataFrame, model: Ranker):
    """Functions of an Arrow batch of docs: its scores, by the text column."""
    given, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return lambda b: given.value.score(features([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]))


def score(docs: DataFrame, model: Ranker, name: str = "score") -> DataFrame:
    """All columns of docs, with the score as `name`. Null text counts as empty; empty texts get a score too."""
    rated, names = _rated(docs, model), [*docs.columns, name]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rated(b), pa.float64())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def accepted(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with their columns, whatever these are called."""
    rated = _rated(docs, model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(rated(b) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    d = score(docs.select("doc_id", "text"), fit(docs, labels))
    return d.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
