"""The shared grid: bounds, indices, dense cells, and how points gather from cells."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A grid is broadcast to its points only up to this size.
BROADCAST_BYTES = 64 << 20
CELL_BYTES = 64


class GridConflict(ValueError):
    pass


@dataclass(frozen=True)
class Grid:
    x_min: float
    y_min: float
    x_max: float
    y_max: float
    resolution: float
    rows: int
    cols: int

    @classmethod
    def of(cls, x_min: float, y_min: float, x_max: float, y_max: float, resolution: float, count: int = 1) -> Grid:
        if not all(map(math.isfinite, (x_min, y_min, x_max, y_max, resolution))) or resolution <= 0:
            raise ValueError("bounds must be finite and the resolution finite and positive")
        if count < 1:
            raise ValueError("no points")
        if x_max < x_min or y_max < y_min:
            raise ValueError("bounds are reversed")
        size = lambda a, b: max(1, math.ceil((b - a) / resolution))
        return cls(x_min, y_min, x_max, y_max, resolution, size(y_min, y_max), size(x_min, x_max))

    @classmethod
    def of_points(cls, points: DataFrame, resolution: float) -> Grid:
        r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
        if not r[4]:
            raise ValueError("no points")
        return cls.of(*r[:4], resolution, r[4])

    def coarse(self, cell: float) -> Grid:
        """The same origin with larger cells; dimensions from the fine grid's whole extent."""
        size = lambda n: max(1, math.ceil(n * self.resolution / cell))
        return Grid(self.x_min, self.y_min, self.x_max, self.y_max, cell, size(self.rows), size(self.cols))

    def index(self, x: Column | str = "x", y: Column | str = "y") -> tuple[Column, Column]:
        """Row and column: truncated toward zero, then clipped; rows grow southward."""
        x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
        at = lambda d, n: F.least(F.greatest((d / F.lit(self.resolution)).cast("int"), F.lit(0)), F.lit(n - 1))
        return at(F.lit(self.y_max) - y, self.rows), at(x - F.lit(self.x_min), self.cols)

    def with_index(self, points: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
        row, col = self.index()
        return points.withColumns({r: row, c: col})

    def centre(self, r: Column | str = "r", c: Column | str = "c") -> tuple[Column, Column]:
        r, c = (F.col(v) if isinstance(v, str) else v for v in (r, c))
        return F.lit(self.x_min) + (c + 0.5) * F.lit(self.resolution), F.lit(self.y_max) - (r + 0.5) * F.lit(self.resolution)

    def cells(self, spark: SparkSession) -> DataFrame:
        n = self.rows * self.cols
        return spark.range(0, n, 1, max(1, min(4096, n // 65536))).select((F.col("id") / self.cols).cast("int").alias("r"), (F.col("id") % self.cols).cast("int").alias("c"))

    def small(self) -> bool:
        return self.rows * self.cols * CELL_BYTES <= BROADCAST_BYTES

    def gather(self, points: DataFrame, cells: DataFrame, on: tuple[str, str] = ("r", "c")) -> DataFrame:
        """Left join of points with dense cells: broadcast while the grid is small, else by (r, c)."""
        return points.join(F.broadcast(cells) if self.small() else cells, list(on), "left")

    def dense(self, sparse: DataFrame) -> DataFrame:
        """Every cell, with the columns of sparse where it has a row."""
        return self.cells(sparse.sparkSession).join(sparse, ["r", "c"], "left")

    def save_once(self, path: str) -> None:
        """Writes the definition; the same one again is no change, another one an error."""
        try:
            with open(path, "x") as f:
                json.dump(asdict(self), f, allow_nan=False)
        except FileExistsError:
            with open(path) as f:
                if json.load(f) != asdict(self):
                    raise GridConflict(f"{path} holds another grid") from None
