"""The final gate's inventory: what the locked candidates hold, and nothing of how well anything scores on them."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import IGNORED_CODES
from ..operators import audit, points
from ..sources import las
from ..sources.sinks import sha256_file
from .guard import Gate, Rect, Refused, inside_folder


@dataclass(frozen=True)
class Candidate:
    """A reference file (relative to the repository) and the rectangle of it that would be scored."""

    region: str
    path: str
    bounds: Rect

    @classmethod
    def of(cls, region: str, path: str, bounds: Sequence[float], folder: str = "data/eval", suffix: str = "_gt.las") -> Candidate:
        if os.path.dirname(path) != folder or not path.endswith(suffix):
            raise Refused(f"{path} is no {folder}/*{suffix}")
        return cls(region, path, Rect.of(bounds))


def inspect(spark: SparkSession, root: str, candidates: list[Candidate]) -> list[dict]:
    """One record a candidate: whether it exists, its points, and the stored codes inside its rectangle (half open).

    Files are hashed before and after they are read and must not change; links are refused. Codes are counted as
    stored: they are no review, and a candidate is never made eligible here.
    """
    las.register(spark)
    out = []
    for c in candidates:
        path, record = inside_folder(root, c.path), {"region": c.region, "candidate": c.path, "bounds": list(c.bounds), "eligible": False}
        if os.path.islink(os.path.join(root, c.path)):
            raise Refused(f"{c.path} is a link")
        if not os.path.exists(path):
            out.append(record | {"exists": False})
            continue
        before = sha256_file(path)
        inside = points.crop(spark.read.format("las").load(path), c.bounds, closed=False)
        counts = {r.code: r.n for r in audit.class_histogram(inside).orderBy("code").collect()}
        if sha256_file(path) != before:
            raise Refused(f"{c.path} has changed while it was read")
        total = sum(las.Header.read(p).count for p in las.paths_of(path))
        reviewed = sum(n for code, n in counts.items() if code not in IGNORED_CODES)
        out.append(record | {"exists": True, "sha256": before, "file_points": total, "points": sum(counts.values()), "codes": {str(k): n for k, n in counts.items()}, "with_class": reviewed})
    return out


def final_gate(spark: SparkSession, gate: Gate, root: str, candidates: list[Candidate], record: dict) -> list[dict]:
    """Opens the gate, once and before any candidate is read, and closes it on the inventory."""
    gate.begin(record | {"candidates": [c.path for c in candidates]})
    found = inspect(spark, root, candidates)
    gate.finish({"candidates": found})
    return found


def audit_suite(pairs: dict[str, tuple], keys: list[str]) -> list[dict]:
    """Before-and-after comparison of named tables (old, new, value column): rows, changes, the greatest difference.

    A table whose two sides don't have the same keys is reported as of another shape.
    """
    out = []
    for name, (old, new, value) in pairs.items():
        left, right = old.select(*keys), new.select(*keys)
        same = left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
        r = audit.compare(old, new, keys, value).select("rows", "changed", F.col("greatest_difference")).first()
        out.append({"name": name, "same_shape": same, "rows": r[0], "changed": r[1], "equal": same and r[1] == 0, "greatest_difference": r[2]})
    return out
