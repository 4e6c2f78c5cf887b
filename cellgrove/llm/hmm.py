"""Hidden Markov language model: Baum-Welch counts over all training documents, exact scores by scaled recursion."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

STATES = 8
#: Words that are symbols of their own (the most frequent); all others emit the class of their last three bytes.
FREQUENT = 20_000
CLASSES = 512
#: Documents, by a hash of doc_id, from which a start is found; then passes over all of them until the log likelihood
#: gains no more than this share.
START_DOCS, START_STEPS, SETTLED = 600, 10, 1e-3
PRIOR = 200.0
#: Documents recursed over side by side, in bytes of text.
BATCH_BYTES = 4 << 20
#: The same for encoded documents, in bytes of symbols.
BATCH_CODED = 2 << 20
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words; the end token is the empty string, added by the callers."""
    return (text or b"").lower().split()


def word_class(w: bytes) -> int:
    return zlib.crc32(w[-3:]) % CLASSES


class Vocabulary:
    """Symbols: 0 the end, 1.. the frequent words, then the classes of all other words, known or not.

    In a class a word has the share (c+1) / T, T the sum of c+1 over its known words and 1 for any unknown one.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], end_count: int, class_mass: dict[int, float]):
        self.symbol = {w: i + 1 for i, (w, _) in enumerate(frequent)}
        self.known = np.array([end_count, *[c for _, c in frequent]], dtype=np.int64)
        self.mass = np.array([class_mass.get(k, 0.0) + 1.0 for k in range(CLASSES)])
        self.size = len(self.known) + CLASSES
        self.log_count = np.log10(np.concatenate((self.known + 1.0, np.ones(CLASSES))))
        self.log_share = np.concatenate((np.zeros(len(self.known)), -np.log10(self.mass)))
        prior = np.concatenate((self.known + 1.0, self.mass))
        self.prior = prior / prior.sum()

    def encode(self, text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
        get, first = self.symbol.get, len(self.known)
        out, rare = [], []
        for w in tokens(text):
            s = get(w)
            if s is None:
                rare.append(w)
                s = first + word_class(w)
            out.append(s)
        out.append(0)
        return np.array(out, dtype=np.int32), rare


class Model:
    """Start, transition and emission probabilities (the last as symbols x states)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, size: int, prior: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.uniform(0.5, 1.5, (size, STATES))
        move = rng.uniform(0.5, 1.5, (STATES, STATES)) + 4 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start, move, emit, prior) -> Model:
        """Smoothed: every state emits the unigram shares with the weight of PRIOR tokens, so no token is impossible."""
        emit = emit + PRIOR * prior[:, None]
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


class _Steps:
    """Sequences side by side, longest first, their symbols step by step: step t holds the first active[t] sequences."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        lens = np.array([len(seqs[i]) for i in self.order])
        self.active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
        self.edge = np.concatenate(([0], np.cumsum(self.active)))
        step = np.repeat(np.arange(lens[0], dtype=np.int64), self.active)
        rank = np.arange(self.edge[-1]) - self.edge[step]
        self.symbols = np.concatenate([seqs[i] for i in self.order])[(np.cumsum(lens) - lens)[rank] + step]
        self.rank = rank

    def forward(self, model: Model, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions and scaled forward variables (states x symbols) and the scale of every step."""
        emit = np.ascontiguousarray(model.emit.T.astype(kind))[:, self.symbols]
        alpha, scale = np.empty_like(emit), np.empty(emit.shape[1], kind)
        onward, edge = np.ascontiguousarray(model.move.T.astype(kind)), self.edge.tolist()
        for t in range(len(self.active)):
            now = alpha[:, edge[t] : edge[t + 1]]
            if t:
                np.matmul(onward, alpha[:, edge[t - 1] : edge[t - 1] + now.shape[1]], out=now)
                now *= emit[:, edge[t] : edge[t + 1]]
            else:
                np.multiply(emit[:, : edge[1]], model.start.astype(kind)[:, None], out=now)
            c = np.add.reduce(now, 0, out=scale[edge[t] : edge[t + 1]])
            now /= c
        return emit, alpha, scale


def log_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability by the scaled forward recursion, all sequences a step at a time."""
    if not seqs:
        return np.zeros(0)
    steps = _Steps(seqs)
    scale = steps.forward(model, np.float64)[2]
    out = np.empty(len(seqs))
    out[steps.order] = np.bincount(steps.rank, weights=np.log10(scale), minlength=len(seqs))
    return out


def expected_counts(model: Model, seqs: list[np.ndarray], size: int, kind=np.float64):
    """Baum-Welch: expected starts, moves and emissions, by scaled forward and backward recursions."""
    return _expected(model, seqs, size, kind)[:3]


def _expected(model: Model, seqs: list[np.ndarray], size: int, kind=np.float32):
    """The expected counts, and the log10 likelihood of the sequences under the model."""
    move, emitted = np.zeros((STATES, STATES)), np.zeros((size, STATES))
    if not seqs:
        return np.zeros(STATES), move, emitted, 0.0
    steps = _Steps(seqs)
    emit, alpha, scale = steps.forward(model, kind)
    emit /= scale
    back, edge = np.ascontiguousarray(model.move.astype(kind)), steps.edge.tolist()
    beta = np.ones((STATES, edge[1]), kind)
    for t in range(len(steps.active) - 1, -1, -1):
        a, b = edge[t], edge[t + 1]
        ahead = beta[:, : b - a]
        if t:
            onward = emit[:, a:b]
            onward *= ahead
            move += alpha[:, edge[t - 1] : edge[t - 1] + b - a] @ onward.T
        alpha[:, a:b] *= ahead
        if t:
            np.matmul(back, onward, out=ahead)
    move *= model.move
    for s in range(STATES):
        emitted[:, s] = np.bincount(steps.symbols, weights=alpha[s], minlength=size)
    first = alpha[:, : edge[1]]
    return (first / first.sum(0)).sum(1).astype(np.float64), move, emitted, float(np.log10(scale.astype(np.float64)).sum())


def held_out(mod: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def _batches(batches, text_at: int, most: int = BATCH_BYTES):
    """Rows of the Arrow batches as tuples, in lots of about so many bytes."""
    rows, size = [], 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            rows.append(r)
            size += len(r[text_at] or b"")
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def count_words(train: DataFrame) -> DataFrame:
    """w, k (class), c: the count of every training word; each task adds up its own first."""

    def run(batches):
        held: Counter = Counter()

        def out():
            ws = list(held)
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([word_class(w) for w in ws], pa.int32()), pa.array([held[w] for w in ws], pa.int64())], names=["w", "k", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
            if len(held) > 400_000:
                yield out()
                held.clear()
        yield out()

    counts = train.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "w binary, k int, c long")
    return counts.groupBy("w", "k").agg(F.sum("c").alias("c"))


def _encoded(train: DataFrame, vocabulary: Vocabulary, every: int) -> DataFrame:
    """first (one document in `every`, by a hash of doc_id) and s, the symbols of a text as bytes; long ones side by side."""
    given = train.sparkSession.sparkContext.broadcast(vocabulary)
    kind = np.min_scalar_type(vocabulary.size)

    def run(batches):
        v = given.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.encode(t)[0].astype(kind).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["first", "s"])

    first = F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0
    return train.select(first.alias("first"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "first boolean, s binary").sortWithinPartitions(F.octet_length("s").desc())


def _full_pass(coded: DataFrame, model: Model, vocabulary: Vocabulary) -> tuple[Model, float]:
    """One Baum-Welch step, and the log likelihood before it: every task adds up the expected counts of its documents, Spark adds up the tasks'."""
    given = coded.sparkSession.sparkContext.broadcast(model)
    n, kind = vocabulary.size, np.min_scalar_type(vocabulary.size)

    def run(batches):
        m, sums = given.value, None
        for rows in _batches(batches, 0, BATCH_CODED):
            part = _expected(m, [np.frombuffer(r[0], kind).astype(np.int32) for r in rows], n)
            sums = part if sums is None else tuple(a + b for a, b in zip(sums, part))
        if sums is not None:
            every = np.concatenate((sums[0][None, :], sums[1], sums[2], np.full((1, STATES), sums[3])))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every)) - 1 - STATES), *(pa.array(every[:, s]) for s in range(STATES))], names=["i", *(f"s{s}" for s in range(STATES))])

    cols = [f"s{s}" for s in range(STATES)]
    rows = coded.select("s").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    every = np.zeros((1 + STATES + n + 1, STATES))
    for r in rows:
        every[r[0] + 1 + STATES] = r[1:]
    given.destroy()
    return Model.from_counts(every[0], every[1 : 1 + STATES], every[1 + STATES : -1], vocabulary.prior), float(every[-1, 0])


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """About FREQUENT words at most, by bins of their counts from the top; the bin that they don't all fit in is filled
    by a hash of the word. So the answer is bounded however many words, equal counts and tasks there are."""
    level, place = F.floor(F.log2("c") * 16).cast("int"), F.pmod(F.xxhash64("w"), F.lit(1 << 20))
    least, room, part = 1 << 30, FREQUENT, 0
    for b, words in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("b")).count().collect()), reverse=True):
        if words > room:
            part = (room << 20) // words
            break
        least, room = b, room - words
    chosen = (level >= least) | ((level == b) & (place < part)) if part else level >= least
    return sorted(((bytes(r[0]), r[1]) for r in counts.where(chosen).select("w", "c").collect()), key=lambda x: (-x[1], x[0]))


def fit(train: DataFrame, counts: DataFrame, end_count: int) -> tuple[Model, Vocabulary]:
    """The model and its symbols, from the training documents (text), their word counts (w, k, c) and their number.

    Baum-Welch from random parameters around the unigram shares: START_STEPS steps over about START_DOCS documents find
    a start, then steps over all documents go on until one gains no more than SETTLED of the log likelihood. Every step
    is one Spark job that adds up expected counts; no text comes to the driver. Null texts are ends alone; without
    documents the random parameters stay.
    """
    frequent = _most_frequent(counts)
    mass = {r[0]: float(r[1]) for r in counts.groupBy("k").agg(F.sum(F.col("c") + 1)).collect()}
    for w, c in frequent:
        mass[word_class(w)] -= c + 1
    v = Vocabulary(frequent, end_count, mass)
    coded = settle(_encoded(train, v, max(1, end_count // START_DOCS)))
    start = settle(coded.where("first").repartition(4))
    m = Model.random(v.size, v.prior)
    for _ in range(START_STEPS):
        m, _ = _full_pass(start, m, v)
    last, gains = -np.inf, True
    while gains:
        m, now = _full_pass(coded, m, v)
        gains, last = now - last > SETTLED * abs(now), now
    return m, v


def score(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each of docs, learnt from train_docs.

    The score is the log10 probability of the words and the end under the model: the exact forward probability of the
    text's symbols, times each word's share of its symbol. Per word it sums to 1 over the known words and one unknown
    word in each class. The counts of rare words never leave Spark: they are joined to the (word, document) pairs and
    added up by document; frequent words, symbols and parameters are of fixed size and travel with the tasks.
    Null text: no words, only the end. Without training documents every probability of base_score is 1 and score
    equals it. Repeated rows stay repeated. A null doc_id is a training document. Further columns are ignored.
    """
    end_count = train_docs.count()
    counts = settle(count_words(train_docs))
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, distinct = n + end_count, distinct + (end_count > 0)
    log_total = float(np.log10(n + distinct + 1))
    model, vocabulary = fit(train_docs, counts, end_count)
    given = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

    def run(batches):
        m, v = given.value
        for rows in _batches(batches, 2):
            coded = [v.encode(r[2]) for r in rows]
            ll = log_likelihood(m, [s for s, _ in coded])
            own = [float(x + v.log_share[s].sum()) for x, (s, _) in zip(ll, coded)]
            base = [float(v.log_count[s].sum()) for s, _ in coded]
            known = [int((v.log_count[s] > 0).sum()) for s, _ in coded]
            rare = [Counter(r) for _, r in coded]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(s) for s, _ in coded], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64()))], names=["doc_id", "h", "n_tokens", "n_known", "base", "own", "ws", "ns"])

    schema = "doc_id long, h long, n_tokens long, n_known long, base double, own double, ws array<binary>, ns array<long>"
    local = settle(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary")).mapInArrow(run, schema))
    pairs = local.select("doc_id", "h", F.explode(F.arrays_zip("ws", "ns")).alias("p")).select("doc_id", "h", F.col("p.ws").alias("w"), F.col("p.ns").alias("n"))
    rare = pairs.join(counts.select("w", "c").hint("shuffle_hash"), "w")
    rare = rare.select("doc_id", "h", F.lit(0).alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.col("n").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("own"), (F.col("n") * F.log10(F.col("c") + 1)).alias("rare"))
    every = local.select("doc_id", "h", F.lit(1).alias("rows"), "n_tokens", "n_known", "base", "own", F.lit(0.0).alias("rare")).unionByName(rare)
    s = every.groupBy("doc_id", "h").agg(F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("rows", "n_known", "base", "own", "rare")])
    # repeated rows have added their parts up; rows counts them
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    base_score = (F.col("base") + F.col("rare")) / F.col("rows") - F.col("n_tokens") * F.lit(log_total)
    own_score = (F.col("own") + F.col("rare")) / F.col("rows")
    return s.select("doc_id", "n_tokens", F.expr("n_known div rows").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base_score.alias("base_score"), (own_score if end_count else base_score).alias("score"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Trained on the documents that are not held out, scored on all, with `held_out`."""
    s = score(docs, docs.where(~held_out()))
    return s.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
