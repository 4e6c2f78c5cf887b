"""Masks as intervals: runs of set pixels by image row (r, columns b to e, half open), without a row for each pixel."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Masks that are cut into intervals at a time.
TOGETHER = 256
_PLACE = [StructField(n, IntegerType()) for n in ("r", "b", "e")]


def of_runs(masks: DataFrame, counts: str = "counts", width: str = "w") -> DataFrame:
    """The other columns with r, b, e for each row of each set run of the run-length masks; null counts give no rows.

    Running sums over all runs of a batch at once; a run that goes over row ends becomes an interval for each row.
    """
    kept = [c for c in masks.columns if c != counts]
    schema = StructType([*(masks.schema[c] for c in kept), *_PLACE])

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        runs, w = b.column(b.schema.get_field_index(counts)), b.column(b.schema.get_field_index(width))
        w = np.nan_to_num(w.to_numpy(zero_copy_only=False)).astype(np.int64)
        lens = np.where(w > 0, pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False), 0)
        runs = runs.filter(pa.array(w > 0, pa.bool_()))
        sizes = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(lens) - lens
        sums = np.concatenate(([0], np.cumsum(sizes)))
        ends, mask = sums[1:] - np.repeat(sums[first], lens), np.repeat(np.arange(len(lens)), lens)
        keep = ((np.arange(len(sizes)) - np.repeat(first, lens)) % 2 == 1) & (sizes > 0)
        e, mask = ends[keep], mask[keep]
        b0, wide = e - sizes[keep], w[mask]
        top, rows = b0 // wide, (e - 1) // wide - b0 // wide + 1
        at = np.repeat(np.arange(len(e)), rows)
        r = top[at] + np.arange(len(at)) - np.repeat(np.cumsum(rows) - rows, rows)
        left, right = np.maximum(b0[at] - r * wide[at], 0), np.minimum(e[at] - r * wide[at], wide[at])
        chosen = pa.array(mask[at])
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(chosen) for c in kept), *(pa.array(x.astype(np.int32)) for x in (r, left, right))], names=schema.names)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                yield cut(b.slice(i, TOGETHER))

    return masks.mapInArrow(run, schema)


class _Sweep:
    """The greatest score alive over the intervals of one image row, given in order of their starts."""

    def __init__(self):
        self.heap: list[tuple[float, int]] = []
        self.at = 0
        self.held: tuple[int, int, float] | None = None  # the last piece, while the next may continue it

    def upto(self, stop: float, out: list) -> None:
        heap = self.heap
        while heap and self.at < stop:
            if heap[0][1] <= self.at:
                heappop(heap)
                continue
            score, end = -heap[0][0], min(heap[0][1], stop)
            if self.held and self.held[1] == self.at and self.held[2] == score:
                self.held = (self.held[0], end, score)
            else:
                self.flush(out)
                self.held = (self.at, end, score)
            self.at = end

    def add(self, b: int, e: int, score: float, out: list) -> None:
        self.upto(b, out)
        self.at = max(self.at, b) if self.heap else b
        heappush(self.heap, (-score, e))

    def flush(self, out: list) -> None:
        if self.held:
            out.append(self.held)
        self.held = None

    def end(self, out: list) -> None:
        self.upto(float("inf"), out)
        self.flush(out)
        self.at = 0


def union(intervals: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by..., r, b, e, score: disjoint intervals with the greatest score over each place, neighbours of equal score joined.

    Rows are sorted and swept, first where they are, so that what overlaps there travels once, then by (by, r). A sweep
    holds what is alive at one place, so no row of an image is too crowded for a task. Null scores and empty intervals
    don't count; keys may be null.
    """
    keys = [*by, "r"]
    rows = intervals.where(F.col(score).isNotNull() & (F.col("b") < F.col("e"))).select(*keys, "b", "e", F.col(score).alias("score"))
    schema = rows.schema

    def run(batches):
        sweep, last, out, owner = _Sweep(), None, [], []

        def drained(t: pa.Table):
            got = t.select(keys).take(pa.array(owner, pa.int64())).combine_chunks()
            cols = list(zip(*out)) or [(), (), ()]
            whole = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns), *(pa.array(c, t.schema.field(n).type) for n, c in zip(("b", "e", "score"), cols))]
            out.clear()
            owner.clear()
            return pa.RecordBatch.from_arrays(whole, names=schema.names)

        def noted(i: int) -> None:
            owner.extend([i] * (len(out) - len(owner)))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if last is None else [*last.to_batches(), b]).combine_chunks()
            codes = np.stack([pc.fill_null(pc.dictionary_encode(t.column(k)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False) for k in keys])
            new = np.concatenate(([False], (codes[:, 1:] != codes[:, :-1]).any(0))).tolist()
            start = 0 if last is None else 1  # the row before stands for its key only
            begins, ends, scores = (t.column(n).to_pylist() for n in ("b", "e", "score"))
            for i in range(t.num_rows):
                if new[i]:
                    sweep.end(out)
                    noted(i - 1)
                if i >= start:
                    sweep.add(begins[i], ends[i], scores[i], out)
                    noted(i)
            last = t.slice(t.num_rows - 1, 1)
            yield drained(t)
        if last is not None:
            sweep.end(out)
            noted(0)
            yield drained(last)

    swept = lambda d: d.sortWithinPartitions(*keys, "b").mapInArrow(run, schema)
    return swept(swept(rows).repartition(*keys))


def pixels(intervals: DataFrame) -> DataFrame:
    """The other columns with r, c for every pixel."""
    kept = [c for c in intervals.columns if c not in ("r", "b", "e", "score")]
    score = ["score"] if "score" in intervals.columns else []
    return intervals.where("b < e").withColumn("c", F.explode(F.sequence("b", F.col("e") - 1))).select(*kept, "r", "c", *score)


def stretched(intervals: DataFrame, h: Column, w: Column, to_h: Column, to_w: Column) -> DataFrame:
    """Intervals of masks of size h x w on images of size to_h x to_w: a pixel takes the mask's value under its centre.

    Bounds are scaled in whole numbers; an interval is repeated for each image row that its row covers, and one that
    covers no pixel's centre goes. Of masks or images without extent nothing is left.
    """
    edge = lambda v, n, m: F.floor((2 * v.cast("long") * m + n - 1) / (2 * n)).cast("int")  # noqa: E731  ceil(v * m / n - 1 / 2)
    d = intervals.where((h > 0) & (w > 0) & (to_h > 0) & (to_w > 0)).withColumns({"_t": edge(F.col("r"), h, to_h), "_u": edge(F.col("r") + 1, h, to_h), "b": edge(F.col("b"), w, to_w), "e": edge(F.col("e"), w, to_w)})
    return d.where("_t < _u and b < e").withColumn("r", F.explode(F.sequence("_t", F.col("_u") - 1))).drop("_t", "_u")


def runs_of(intervals: DataFrame, masks: DataFrame, by: list[str], h: str = "h", w: str = "w") -> DataFrame:
    """by..., h, w, counts: run-length masks of disjoint or touching intervals; masks (by..., h, w) without any are empty.

    All intervals of one mask meet in a task: as many as it has runs.
    """
    flat = lambda c: F.col("r").cast("long") * F.col(w) + F.col(c)
    size = F.col(h).cast("long") * F.col(w)
    spans = masks.select(*by, h, w).join(intervals.select(*by, "r", "b", "e"), by, "left").groupBy(*by, h, w).agg(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct(flat("b").alias("b"), flat("e").alias("e"))))).alias("_s"))

    def counts(b: pa.RecordBatch, n: np.ndarray) -> pa.Array:
        out = []
        for row, total in zip(b.column(b.schema.get_field_index("_s")), n.tolist()):
            at = np.array([(x["b"], x["e"]) for x in row.as_py()], np.int64).reshape(-1, 2)
            begin, end = at[:, 0], np.maximum.accumulate(at[:, 1])
            new = np.concatenate((begin[:1] >= 0, begin[1:] > end[:-1])).astype(bool)
            edges = np.stack((begin[new], end[np.concatenate((new[1:], [True]))[: len(end)]]), 1).ravel() if len(at) else begin
            runs = np.diff(np.concatenate(([0], edges, [total])))
            out.append(runs[:-1] if len(runs) > 1 and runs[-1] == 0 else runs)
        return pa.array(out, pa.list_(pa.int32()))

    kept = [*by, h, w]
    schema = StructType([*(spans.schema[c] for c in kept), StructField("counts", masks.sparkSession.createDataFrame([], "c array<int>").schema[0].dataType)])

    def run(batches):
        for b in batches:
            n = b.column(b.schema.get_field_index("_n")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), counts(b, n)], names=schema.names)

    return spans.withColumn("_n", size).mapInArrow(run, schema)


def boxes(intervals: DataFrame, masks: DataFrame, by: list[str]) -> DataFrame:
    """The box of each mask: least and greatest pixel + 1; zeros for an empty one."""
    box = intervals.where("b < e").groupBy(*by).agg(F.min("b").alias("x0"), F.min("r").alias("y0"), F.max("e").alias("x1"), (F.max("r") + 1).alias("y1"))
    return masks.select(*by).join(box, by, "left").fillna(0, ["x0", "y0", "x1", "y1"])


def coverage(united: DataFrame, cells: int, floor: float = 0.1) -> DataFrame:
    """By class, of disjoint intervals: the share of all cells with a score over the floor, and the greatest score."""
    wide = (F.col("e") - F.col("b")).cast("long")
    return united.groupBy("class").agg((F.coalesce(F.sum(F.when(F.col("score") > F.lit(floor).cast("float"), wide)), F.lit(0)) / F.lit(float(cells))).alias("coverage"), F.max("score").alias("top"))


def stitched(tiles: DataFrame) -> DataFrame:
    """Tile intervals (row0, col0, r, b, e, class, score) on the whole grid: r, b, e, class, score, disjoint by class."""
    d = tiles.select("class", (F.col("row0") + F.col("r")).cast("int").alias("r"), (F.col("col0") + F.col("b")).cast("int").alias("b"), (F.col("col0") + F.col("e")).cast("int").alias("e"), "score")
    return union(d, ["class"])
