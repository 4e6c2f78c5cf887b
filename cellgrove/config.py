"""Immutable parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Class table (id, name, prompt, threshold, LAS code), thresholds and windows of the published method.
CLASSES = [
    (0, "pavement", "road", 0.30, 11),
    (1, "sidewalk", "sidewalk", 0.30, 11),
    (2, "parking", "parking lot", 0.30, 11),
    (3, "grass", "grass", 0.35, 3),
    (4, "tree", "tree", 0.45, 5),
    (5, "building", "building", 0.50, 6),
    (6, "vehicle", "car", 0.50, 64),
]
UNLABELLED, UNLABELLED_CODE = -1, 1
PRIORITY = ("vehicle", "tree", "building", "sidewalk", "parking", "pavement", "grass")
IGNORED_CODES = (0, 1)
REFERENCE_CODES = (3, 5, 6, 11, 64)
CODE_NAMES = {3: "grass", 5: "tree", 6: "building", 11: "pavement", 64: "vehicle"}
GRID_RESOLUTION, CHUNK_SIZE = 0.5, 10_000_000
DECIMATE_CELL, CLOTH_RESOLUTION, GROUND_OUTLIER = 2.0, 2.0, 5.0
GAPFILL = (5, 17, 65)
TOP_SURFACE, TILE, TILE_STEP, COLOUR_DIVISOR, INPAINT_RADIUS = 1.5, 1024, 768, 257, 3
BOX_FRACTION, MAJORITY = 0.8, 5
MAX_TILE_INDEX, COORDINATE_TOLERANCE = 1 << 24, 0.01


@dataclass(frozen=True)
class Veto:
    tree_exg: float = 0.10
    tree_hag: float = 6.0
    grass_exg: float = 0.05
    grass_hag: float = 2.0
    building_hag: float = 8.0
    pavement_hag: float = 1.5
    vehicle_low: float = 1.0
    vehicle_high: float = 9.0


@dataclass(frozen=True)
class Transfer:
    surface: float = 3.0
    below_tree: float = 2.0
    below_grass: float = 0.05
    rule_conf: int = 128


@dataclass(frozen=True)
class Baseline:
    building_hag: float = 8.0
    tree_hag: float = 6.0
    grass_hag: float = 2.0
    pavement_hag: float = 1.5
    veg_exg: float = 0.05
    hard_exg: float = 0.05


@dataclass(frozen=True)
class Fusion:
    """Component switches of fusion; the defaults are production."""

    constraints: bool = True
    smoothing: bool = True
    window: int = MAJORITY
    tree_height_check: bool = False
    physical_smoothing: bool = False
    veto: Veto = field(default_factory=Veto)
    priority: tuple[str, ...] = PRIORITY


IDS = {name: i for i, name, *_ in CLASSES}
THRESHOLDS = {name: t for _, name, _, t, _ in CLASSES}
LAS_CODES = {i: code for i, *_, code in CLASSES} | {UNLABELLED: UNLABELLED_CODE}
