"""Neighbourhood operators on dense grids in long form.

Sums over edge-replicated windows are summed areas: running sums along rows, then along columns, each one sort; what a
clamped offset would repeat is added as a multiple of the edge value. Costs don't grow with the window. Order
statistics of small windows scatter each cell to the cells that it serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSES, GAPFILL, GROUND_OUTLIER, MAJORITY
from ..functions.scalar import f32
from .grid import Grid


def window_sums(cells: DataFrame, grid: Grid, values: dict[str, tuple[Column, tuple[int, ...]]]) -> DataFrame:
    """Adds, for each name and each of its sizes, name_size: the sum over the size x size window with edge-replicated padding.

    Summed areas, one axis after the other: running sums along the rows, of which a window's sum is the difference of
    two, and again along the columns. Work per cell doesn't depend on the sizes, and all values and sizes share the two
    sorts. Nulls count 0.
    """
    kept = cells.columns

    def along(d: DataFrame, across: str, by: str, n: int, sums: dict[str, dict[str, int]]) -> DataFrame:
        """sums: for each column its window sums (name: size)."""
        w = Window.partitionBy(across).orderBy(by)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumns({f"{v}_p": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in sums})
        ends = {f"{v}_{k}": f(c).over(whole) for v in sums for k, f, c in (("a", F.first, v), ("y", F.last, v), ("z", F.last, f"{v}_p"))}
        moved = {}
        for v, own in sums.items():
            for size in own.values():
                moved[f"{v}_u{size}"] = F.lead(f"{v}_p", size - size // 2 - 1).over(w)
                moved[f"{v}_d{size}"] = F.lag(f"{v}_p", size // 2 + 1).over(w)
        d, out = d.withColumns(ends | moved), []
        for v, own in sums.items():
            for name, size in own.items():
                short = F.greatest(F.lit(size // 2) - F.col(by), F.lit(0))
                over = F.greatest(F.col(by) + F.lit(size - size // 2 - n), F.lit(0))
                inner = F.coalesce(f"{v}_u{size}", f"{v}_z") - F.coalesce(F.col(f"{v}_d{size}"), F.lit(0))
                out.append((inner + short * F.col(f"{v}_a") + over * F.col(f"{v}_y")).alias(name))
        return d.select(*kept, *out)

    d = cells.withColumns({f"_{v}": F.coalesce(c, F.lit(0)) for v, (c, _) in values.items()})
    d = along(d, "r", "c", grid.cols, {f"_{v}": {f"{v}_{s}": s for s in sizes} for v, (_, sizes) in values.items()})
    return along(d, "c", "r", grid.rows, {f"{v}_{s}": {f"{v}_{s}": s} for v, (_, sizes) in values.items() for s in sizes})


def box_mean(cells: DataFrame, grid: Grid, size: int, value: str, out: str = "mean") -> DataFrame:
    d = window_sums(cells, grid, {"_m": (F.col(value).cast("double"), (size,))})
    return d.withColumn(out, F.col(f"_m_{size}") / (size * size)).drop(f"_m_{size}")


def fill_gaps(cells: DataFrame, grid: Grid, value: str = "z", windows: tuple[int, ...] = GAPFILL) -> DataFrame:
    """Empty cells take the mean of the original cells in ever larger windows; what is left the least value of all.

    A mean is never below the least cell, so the least value is that of the original cells, and the windows run once.
    """
    v = F.col(value).cast("double")
    d = window_sums(cells, grid, {"_n": (v, windows), "_d": (v.isNotNull().cast("long"), windows)})
    filled = [F.when(F.col(f"_d_{s}") > 0, F.try_divide(F.col(f"_n_{s}"), F.col(f"_d_{s}"))) for s in windows]
    least = cells.agg(F.min(v).alias("_least"))
    return d.crossJoin(F.broadcast(least)).withColumn(value, F.coalesce(v, *filled, "_least")).select(*cells.columns)  # one row


def _scatter(cells: DataFrame, grid: Grid, reach: int, *values: str) -> DataFrame:
    """Each cell's values at every cell that it is a neighbour of (itself too), within bounds."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    d = cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    d = d.select((F.col("r") + F.col("_i")).alias("r"), (F.col("c") + F.col("_j")).alias("c"), "_i", "_j", *values)
    return d.where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1))


def low_outliers(lowest: DataFrame, grid: Grid, below: float = GROUND_OUTLIER) -> DataFrame:
    """Occupied cells (r, c, z) with the 5 x 5 median, and whether they lie more than `below` under it.

    Cells out of bounds are absent, empty ones count as infinitely high; an infinite median rejects nothing.
    """
    seen = _scatter(lowest.withColumnRenamed("z", "_z"), grid, 2, "_z").groupBy("r", "c").agg(F.sort_array(F.collect_list("_z")).alias("_zs"))
    span = lambda at, n: F.least(F.col(at) + 2, F.lit(n - 1)) - F.greatest(F.col(at) - 2, F.lit(0)) + 1
    m = span("r", grid.rows) * span("c", grid.cols)
    upper = F.floor(m / 2).cast("int")
    lower = F.when(m % 2 == 0, upper - 1).otherwise(upper)
    median = (F.get("_zs", lower) + F.get("_zs", upper)) / 2
    d = lowest.join(seen, ["r", "c"]).withColumn("median", median)
    return d.select("r", "c", "z", "median", F.coalesce(F.col("z") < F.col("median") - below, F.lit(False)).alias("outlier"))


_IDS = [-1, *(i for i, *_ in CLASSES)]
_VOTES = 1 << 30  # two counts go into one number: no window, nor a line's running sum of windows, has as many cells


def modes(cells: DataFrame, grid: Grid, labels: dict[str, tuple[Column, tuple[int, ...]]]) -> tuple[DataFrame, dict[tuple[str, int], Column]]:
    """Cells with the vote counts of several labels (name: the label and the odd windows wanted of it), all from one set
    of running sums, and for (name, window) the most frequent label. -1 votes; of equals the smallest id wins."""
    if any(s < 1 or s % 2 == 0 for _, sizes in labels.values() for s in sizes):
        raise ValueError("a window must be odd and positive")
    vote = lambda label, k: (label == _IDS[k]).cast("long") if k < len(_IDS) else F.lit(0).cast("long")
    pairs, values = range(0, len(_IDS), 2), {}
    for n, (label, sizes) in labels.items():
        if wide := tuple(s for s in sizes if s > 1):
            values |= {f"_{n}{k}": (vote(label, k) + vote(label, k + 1) * _VOTES, wide) for k in pairs}
    out = {}
    for n, (label, sizes) in labels.items():
        for s in sizes:
            counts = [x for k in pairs for v in [F.col(f"_{n}{k}_{s}")] for x in (F.pmod(v, F.lit(_VOTES)), F.shiftright(v, 30))]
            best = F.array_max(F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("i")) for v, i in zip(counts, _IDS)]))["i"]
            out[n, s] = (-best).cast("int") if s > 1 else label
    return window_sums(cells, grid, values) if values else cells, out


def majority(cells: DataFrame, grid: Grid, size: int = MAJORITY, label: str = "label") -> DataFrame:
    """The most frequent label of the edge-replicated window; -1 votes; of equals the smallest id."""
    d, found = modes(cells, grid, {"v": (F.col(label), (size,))})
    return d.withColumn(label, found["v", size]).select(*cells.columns)


def ranges(cells: DataFrame, grid: Grid, height: str = "z", colour: str = "exg") -> DataFrame:
    """For occupied cells the 3 x 3 ranges of height and colour, and whether a neighbour is empty (a border counts)."""
    d = _scatter(cells.withColumnsRenamed({height: "_z", colour: "_e"}), grid, 1, "_z", "_e").groupBy("r", "c").agg(F.max("_z").alias("_z1"), F.min("_z").alias("_z0"), F.max("_e").alias("_e1"), F.min("_e").alias("_e0"), F.count(F.lit(1)).alias("_n"))
    return cells.join(d, ["r", "c"]).withColumns({"z_range": F.col("_z1") - F.col("_z0"), "exg_range": F.col("_e1") - F.col("_e0"), "empty_neighbour": F.col("_n") < 9}).drop("_z0", "_z1", "_e0", "_e1", "_n")


def boundary_flag(z_range: str = "z_range", exg_range: str = "exg_range") -> Column:
    return F.col("empty_neighbour") | F.coalesce(F.col(z_range) > 2.0, F.lit(False)) | F.coalesce(F.col(exg_range) > 0.05, F.lit(False))


def bilinear(coarse: DataFrame, small: Grid, large: Grid, value: str = "z", out: str = "dtm") -> DataFrame:
    """The coarse raster stretched over the large grid: half-pixel centres, clamped at the edges, float32.

    The large grid is made, not joined: each coarse cell gets its neighbours below and to the right by two sorts of the
    coarse raster, and then yields the large cells whose centres lie between the four. Empty cells weigh nothing; where
    all four are empty, so is the result.
    """
    d = small.dense(coarse.select("r", "c", F.col(value).cast("double").alias("v00")))
    d = d.withColumn("v01", F.lead("v00", 1).over(Window.partitionBy("r").orderBy("c")))
    down = Window.partitionBy("c").orderBy("r")
    d = d.withColumns({"v10": F.lead("v00", 1).over(down), "v11": F.lead("v01", 1).over(down)})

    def side(d: DataFrame, at: str, n: int, m: int) -> DataFrame:
        """The places 0..n-1 whose centres lie between a cell and the next, with the next one's weight. Beyond the first
        and the last cell both are that cell."""
        place = lambda k: (k + 0.5) * F.lit(m / n) - 0.5
        low = F.when(F.col(at) == 0, 0).otherwise(F.floor((F.col(at) + 0.5) * F.lit(n / m) - 0.5) - 1)
        high = F.when(F.col(at) == m - 1, n - 1).otherwise(F.ceil((F.col(at) + 1.5) * F.lit(n / m) - 0.5) + 1)
        near = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n - 1)).cast("int"))
        own = lambda k: F.least(F.greatest(F.floor(place(k)), F.lit(0)), F.lit(m - 1)) == F.col(at)
        d = d.withColumn(f"_{at}", F.explode(F.filter(near, own)))
        s = place(F.col(f"_{at}"))
        return d.withColumns({f"_w{at}": s - F.floor(s), f"_e{at}": (s < 0) | (F.col(at) == m - 1)})

    d = side(side(d, "r", large.rows, small.rows), "c", large.cols, small.cols)
    wr, wc = (1 - F.col("_wr"), F.col("_wr")), (1 - F.col("_wc"), F.col("_wc"))
    below = F.when(F.col("_er"), F.col("v00")).otherwise(F.col("v10"))  # a neighbour beyond the edge is the edge itself
    beside = F.when(F.col("_ec"), F.col("v00")).otherwise(F.col("v01"))
    across = F.when(F.col("_er"), beside).when(F.col("_ec"), below).otherwise(F.col("v11"))
    corners = {(0, 0): F.col("v00"), (0, 1): beside, (1, 0): below, (1, 1): across}
    total = sum((F.coalesce(wr[i] * wc[j] * v, F.lit(0.0)) for (i, j), v in corners.items()), F.lit(0.0))
    return d.select(F.col("_r").alias("r"), F.col("_c").alias("c"), f32(F.when(F.coalesce(*corners.values()).isNotNull(), total)).alias(out))


def resize_mask(logits: DataFrame, small: Grid, large: Grid, value: str = "logit") -> DataFrame:
    """Logits stretched bilinearly, as probabilities, and whether these exceed 0.5."""
    d = bilinear(logits, small, large, value, "_x")
    p = 1 / (1 + F.exp(-F.col("_x").cast("double")))
    return d.select("r", "c", p.alias("probability"), (p > 0.5).alias("mask"))


def grid_sample(cells: DataFrame, grid: Grid, at: DataFrame, value: str, out: str = "sample") -> DataFrame:
    """Rows of `at` (y, x in cells, cell centres at whole numbers) with the bilinear value; cells out of bounds count 0."""
    row, col = F.floor("y").cast("int"), F.floor("x").cast("int")
    d, total = at.withColumns({"_y": F.col("y") - F.floor("y"), "_x": F.col("x") - F.floor("x")}), F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            d = d.withColumns({"_r": row + i, "_c": col + j})
            d = grid.gather(d, cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).cast("double").alias(f"_v{i}{j}")), ("_r", "_c"))
            weight = (F.col("_y") if i else 1 - F.col("_y")) * (F.col("_x") if j else 1 - F.col("_x"))
            total = total + F.coalesce(weight * F.col(f"_v{i}{j}"), F.lit(0.0))
    return d.select(*at.columns, total.alias(out))


def roi_align(cells: DataFrame, grid: Grid, boxes: DataFrame, value: str, size: tuple[int, int], samples: int = 2, key: str = "box") -> DataFrame:
    """key, i, j, value: each box (bbox: x0, y0, x1, y1 in cells) cut into size bins, with the mean of samples x samples
    evenly spaced bilinear values in each. Places are half-pixel aligned; within a cell of the border they are clamped,
    farther out they count 0."""
    h, w = size
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = boxes.select(key, "bbox").withColumn("i", each(h)).withColumn("j", each(w)).withColumn("_p", each(samples)).withColumn("_q", each(samples))
    b = lambda k: F.get("bbox", k).cast("double")
    y = b(1) - 0.5 + (F.col("i") + (F.col("_p") + 0.5) / samples) * (b(3) - b(1)) / h
    x = b(0) - 0.5 + (F.col("j") + (F.col("_q") + 0.5) / samples) * (b(2) - b(0)) / w
    d = d.withColumns({"y": y, "x": x}).withColumn("_in", F.col("y").between(-1, grid.rows) & F.col("x").between(-1, grid.cols))
    clamp = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0))
    d = grid_sample(cells, grid, d.withColumns({"y": clamp("y", grid.rows), "x": clamp("x", grid.cols)}), value, "_v")
    return d.groupBy(key, "i", "j").agg(F.avg(F.when(F.col("_in"), F.col("_v")).otherwise(0.0)).alias("value"))
