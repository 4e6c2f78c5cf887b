import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.config import CLASSES, IDS, THRESHOLDS, Fusion
from cellgrove.operators import fusion, metrics, transfer
from cellgrove.operators.grid import Grid

NAMES = [n for _, n, *_ in CLASSES]


def test_baseline(spark):
    rows = [(0.0, 10.0), (0.2, 8.0), (0.2, 0.5), (0.0, 0.5), (0.0, 4.0), (None, None), (0.2, 30.0)]
    d = spark.createDataFrame(rows, "exg float, hag float")
    assert [r[0] for r in d.select(fusion.baseline()).collect()] == [5, 4, 3, 0, -1, -1, 4]


def test_thresholds_are_float32(spark):
    d = spark.createDataFrame([(0.05, 1.0), (0.1, 7.0)], "exg float, hag float").withColumn("void", F.lit(False))
    grass, tree = d.select(fusion.veto("grass")).collect()[0][0], d.select(fusion.veto("tree")).collect()[1][0]
    assert grass is False and tree is True
    with pytest.raises(ValueError):
        fusion.veto("water")


def random_cells(spark, seed, rows=11, cols=14):
    """A grid of random confidences, heights and greenness around all thresholds, with voids and unknown values."""
    rng = np.random.default_rng(seed)
    cells = {}
    for r in range(rows):
        for c in range(cols):
            likely = NAMES[(r // 4 * 3 + c // 5) % len(NAMES)]  # patches of one class, with noise
            usual = rng.random() < 0.75
            height = {"tree": 12.0, "building": 9.0, "vehicle": 2.0}.get(likely, 0.1) if usual else float(rng.choice([0.1, 1.2, 1.5, 2.0, 5.0, 6.0, 7.5, 8.0, 9.0, 12.0]))
            green = (0.3 if likely in ("tree", "grass") else 0.0) if usual else float(rng.choice([0.0, 0.05, 0.07, 0.1, 0.3]))
            void, unknown = bool(rng.random() < 0.1), rng.random() < 0.1
            score = {n: 0.9 if n == likely and rng.random() < 0.85 else float(rng.choice([0.0, 0.3, 0.35, 0.45, 0.5])) if rng.random() < 0.15 else 0.0 for n in NAMES}
            cells[r, c] = {"void": void, "hag": None if void or unknown else float(np.float32(height)), "exg": None if void else float(np.float32(green)), **{n: float(np.float32(x)) for n, x in score.items()}}
    schema = "r int, c int, void boolean, hag float, exg float, " + ", ".join(f"{n} float" for n in NAMES)
    d = spark.createDataFrame([(r, c, x["void"], x["hag"], x["exg"], *(x[n] for n in NAMES)) for (r, c), x in cells.items()], schema)
    return Grid(0, 0, cols, rows, 1.0, rows, cols), cells, d


def allowed(name, x, v):
    """Physics by hand: unknown values never allow anything."""
    f = np.float32
    more = lambda k, t: x[k] is not None and f(x[k]) > f(t)
    less = lambda k, t: x[k] is not None and f(x[k]) < f(t)
    if x["void"]:
        return False
    if name == "tree":
        return more("exg", v.tree_exg) or more("hag", v.tree_hag)
    if name == "grass":
        return more("exg", v.grass_exg) and less("hag", v.grass_hag)
    if name == "building":
        return more("hag", v.building_hag)
    if name == "vehicle":
        return more("hag", v.vehicle_low) and less("hag", v.vehicle_high)
    return less("hag", v.pavement_hag)


def fused_by_hand(cells, o):
    tall = lambda x: not x["void"] and x["hag"] is not None and np.float32(x["hag"]) > np.float32(o.veto.tree_hag)
    before = {}
    for at, x in cells.items():
        kept = {n for n in NAMES if np.float32(x[n]) >= np.float32(THRESHOLDS[n]) and (allowed(n, x, o.veto) if o.constraints else not x["void"])}
        if o.tree_height_check and not tall(x):
            kept.discard("tree")
        before[at] = next((IDS[n] for n in o.priority if n in kept), -1)
    rows, cols, h = max(r for r, _ in cells), max(c for _, c in cells), o.window // 2
    out = {}
    for (r, c), x in cells.items():
        label = before[r, c]
        if o.smoothing:
            votes = [before[min(max(r + i, 0), rows), min(max(c + j, 0), cols)] for i in range(-h, h + 1) for j in range(-h, h + 1)]
            label = min(set(votes), key=lambda k: (-votes.count(k), k))
            if o.physical_smoothing and (label < 0 or not allowed(NAMES[label], x, o.veto)):
                label = before[r, c]
            if o.tree_height_check and label == IDS["tree"] and not tall(x):
                label = before[r, c]
        out[r, c] = (label, x[NAMES[label]] if label >= 0 else 0.0)
    return out


@pytest.mark.parametrize("options", [Fusion(), Fusion(constraints=False), Fusion(smoothing=False), Fusion(window=3), Fusion(tree_height_check=True), Fusion(physical_smoothing=True), Fusion(tree_height_check=True, physical_smoothing=True)])
def test_fusion_by_hand(spark, options):
    g, cells, d = random_cells(spark, 5)
    got = {(r.r, r.c): (r.label, r.score) for r in fusion.fuse(d, g, options).collect()}
    assert got == fused_by_hand(cells, options) and len({label for label, _ in got.values()}) >= 4


def test_veto_stats_by_hand(spark):
    _, cells, d = random_cells(spark, 6)
    for r in fusion.veto_stats(d).collect():
        n = r["class"]
        claimed = [x for x in cells.values() if np.float32(x[n]) >= np.float32(THRESHOLDS[n])]
        kept = [x for x in claimed if allowed(n, x, Fusion().veto)]
        assert (r.claimed_px, r.kept_px) == (len(claimed), len(kept)) and r.vetoed == pytest.approx(1 - len(kept) / len(claimed))


SCHEMA = "id int, z double, hag float, exg float, label int, score float, surface_z float"


def test_sources_and_routes(spark):
    rows = [
        (0, 10.0, 0.0, 0.0, 4, 0.8, 10.0), (1, 4.0, 3.0, 0.0, 4, 0.8, 10.0), (2, 4.0, 1.0, 0.2, 4, 0.8, 10.0), (3, 4.0, 1.0, 0.0, 4, 0.8, 10.0),
        (4, 4.0, 1.0, 0.2, 4, 0.8, None), (5, 14.0, 9.0, 0.0, 4, 0.8, 10.0), (6, 10.0, 0.0, 0.0, -1, 0.0, 10.0), (7, 10.0, 0.0, 0.0, 4, 0.0, 10.0),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted(transfer.transfer(d).collect(), key=lambda r: r.id)
    assert [r.internal_class_id for r in got] == [4, 4, 3, 0, 3, 4, -1, 4]
    assert [r.prediction_source for r in got] == [1, 2, 2, 2, 3, 4, 0, 1]
    assert [r.id for r in got if r.model_score is not None] == [0, 7]
    assert [r.id for r in got if r.route == "transfer"] == [0, 6, 7]
    naive = sorted(transfer.transfer(d, "naive").collect(), key=lambda r: r.id)
    assert {r.route for r in naive} == {"transfer"} and [r.prediction_source for r in naive] == [1, 1, 1, 1, 1, 1, 0, 1]
    assert transfer.transfer(d, band=7.0).where("route = 'transfer'").count() == 7
    legacy = sorted(transfer.transfer_legacy(d).collect(), key=lambda r: r.id)
    assert [r.conf_out for r in legacy] == [204, 128, 128, 128, 128, 128, 0, 0]
    for bad in ({"mode": "other"}, {"band": 0.0}, {"band": float("nan")}):
        with pytest.raises(ValueError):
            transfer.transfer(d, **bad)


def test_surface_band_is_strict(spark):
    d = spark.createDataFrame([(0, 13.0, 0.0, 0.0, 4, 0.5, 10.0)], SCHEMA)
    assert transfer.transfer(d).first().route == "fallback"
    with pytest.raises(ValueError):
        transfer.require_transferable(d.withColumn("score", F.lit(2.0)))


def scores(spark, ref, pred):
    d = spark.createDataFrame(list(zip(ref, pred)), "ref int, pred int")
    c = metrics.per_class(metrics.confusion_strict(d))
    return metrics.summary(c).first(), {r.code: r for r in c.collect()}


def test_metrics(spark):
    total, by = scores(spark, [3, 3, 5, 5], [3, 5, 3, 1])
    assert (by[3].precision, by[3].recall, by[3].f1) == (0.5, 0.5, 0.5) and abs(by[3].iou - 1 / 3) < 1e-12 and by[5].iou == 0
    assert by[6].precision is None and by[6].support == 0 and total.unlabelled_points == 1
    assert total.primary_loss == 0.75 and total.label_coverage == 0.75


def test_balancing(spark):
    a, _ = scores(spark, [3] * 9 + [5], [3] * 10)
    b, _ = scores(spark, [3] * 9 + [5], [3] * 7 + [5] * 3)
    assert a.overall_accuracy > b.overall_accuracy and a.primary_loss > b.primary_loss


def test_empty_strata_stay(spark):
    d = spark.createDataFrame([(3, 3, True), (5, 3, True)], "ref int, pred int, some boolean").withColumn("none", F.lit(False))
    got = {r.stratum: (r.scored_points, r.share_of_reviewed_points, r.primary_loss) for r in metrics.strata_scores(d, ["some", "none"]).collect()}
    assert got == {"some": (2, 1.0, 0.5), "none": (0, 0.0, None)}


def test_selection(spark):
    rows = [("b", 0.1, 1, 4, 1.0), ("a", 0.1 + 1e-14, 0, 5, 9.0), ("c", 0.2, 0, 1, 0.0)]
    d = spark.createDataFrame(rows, "name string, loss double, learned int, stages int, seconds double")
    assert metrics.select_best(d).first().name == "a"
    with pytest.raises(ValueError):
        metrics.select_best(d.withColumn("complete", F.col("name") != "c"))


def test_shuffled_rows_score_the_same(spark):
    rng = np.random.default_rng(1)
    ref, pred = rng.choice([3, 5, 6], 200).tolist(), rng.choice([3, 5, 6, 1, 99], 200).tolist()
    order = rng.permutation(200)
    a, _ = scores(spark, ref, pred)
    b, _ = scores(spark, [ref[i] for i in order], [pred[i] for i in order])
    assert a.primary_loss == pytest.approx(b.primary_loss, abs=1e-12) and a.invalid_points == b.invalid_points
