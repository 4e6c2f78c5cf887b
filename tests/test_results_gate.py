"""Result tables from one count, the final gate's inventory, the audit suite, and the commands over them."""

import csv
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove import __main__ as cli
from cellgrove.operators import metrics
from cellgrove.plans import candidates, experiments, guard, results
from cellgrove.sources import las

CODES = (3, 5, 6, 11, 64)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in ("rules_c0_s0_naive", "neural_c0_s0_naive", "point_rules"):
        rows += [(m, int(rng.choice([3, 5, 6, 11, 1, 0])), int(rng.choice([3, 5, 6, 11, 64, 1, 77])), bool(rng.random() < 0.4), None if rng.random() < 0.1 else bool(rng.random() < 0.7), False, str(rng.choice(["transfer", "fallback"])) if rng.random() < 0.9 else None) for _ in range(500)]
    return spark.createDataFrame(rows, "method string, ref int, pred int, surface boolean, below boolean, never boolean, route string").repartition(4), rows


def plain(rows):
    """Figures of reviewed (ref, pred) pairs."""
    rows = [(r, p) for r, p in rows if r in CODES]
    losses, ious = [], []
    for c in CODES:
        n, tp, fp = sum(r == c for r, _ in rows), sum(r == p == c for r, p in rows), sum(r != c and p == c for r, p in rows)
        if n:
            losses.append(1 - tp / n)
            ious.append(tp / (n + fp))
    return len(rows), sum(r != p for r, p in rows), 100 * sum(losses) / len(losses), 100 * sum(r == p for r, p in rows) / len(rows), 100 * sum(ious) / len(ious), sum(p == 1 for _, p in rows), sum(p == 77 for _, p in rows)


def test_tables(spark, scored):
    d, rows = scored
    found = results.tables(results.counted(d, ["surface", "below", "never"]).checkpoint(), {"point_rules": "rule"})
    assert list(found) == ["all_methods", "confusion_matrices", "per_class_metrics", "strata_and_routes", "strata_and_routes_confusion_matrices", "strata_and_routes_per_class_metrics"]
    names = ["points", "errors", "balanced_error_percent", "accuracy_percent", "mean_iou_percent", "unlabelled", "invalid"]
    for r in found["all_methods"].collect():
        assert [r[n] for n in names] == pytest.approx(plain([(x[1], x[2]) for x in rows if x[0] == r.method]))
        assert r.proposal_score_kind == ("rule" if r.method == "point_rules" else None) and r.vehicle_iou_percent is None and r.tree_iou_percent is not None
    at = {"surface": 3, "below": 4, "never": 5}
    parts = found["strata_and_routes"].collect()
    assert {(r.group, r.subset) for r in parts} == {("strata", "surface"), ("strata", "below"), ("routes", "transfer"), ("routes", "fallback")}
    for r in parts:
        own = [(x[1], x[2]) for x in rows if x[0] == r.method and (x[at[r.subset]] if r.group == "strata" else x[6] == r.subset)]
        assert [r[n] for n in names] == pytest.approx(plain(own))
        assert r.share_percent == pytest.approx(100 * plain(own)[0] / plain([(x[1], x[2]) for x in rows if x[0] == r.method])[0])
    cm = found["confusion_matrices"].collect()
    assert len(cm) == 3 * 35 and all(r["count"] == sum(x[0] == r.method and x[1] == r.reference and (str(x[2]) == r.prediction or (x[2] == 1 and r.prediction == "unlabelled") or (x[2] == 77 and r.prediction == "invalid")) for x in rows) for r in cm)
    per = {(r.method, r.reference): r for r in found["per_class_metrics"].collect()}
    assert per["point_rules", 64].precision_percent is None and not per["point_rules", 64].present and per["point_rules", 3].support == sum(x[0] == "point_rules" and x[1] == 3 for x in rows)
    again = metrics.summary(metrics.per_class(metrics.confusion_strict(d, by=["method"]), ["method"]), ["method"]).collect()
    assert {r.method: r.error_points for r in again} == {r.method: r.errors for r in found["all_methods"].collect()}


def test_effects_and_files(spark, scored, tmp_path):
    found = results.tables(results.counted(scored[0], ["surface"]).checkpoint())
    effect = results.source_effect(found["all_methods"], experiments.configurations()).collect()
    loss = {r.method: r.balanced_error_percent for r in found["all_methods"].collect()}
    assert len(effect) == 1 and effect[0].neural_minus_rules_pp == pytest.approx(loss["neural_c0_s0_naive"] - loss["rules_c0_s0_naive"]) and not effect[0].constraints
    pair = results.before_and_after(found["all_methods"], found["all_methods"], {"point_rules": "neural_c0_s0_naive", "none": "point_rules"}).collect()
    assert [r.method for r in pair] == ["point_rules"] and pair[0].delta_errors == pair[0].new_errors - pair[0].old_errors
    rows = results.write({n: found[n] for n in ("all_methods", "strata_and_routes")}, str(tmp_path / "t"))
    part = next((tmp_path / "t" / "all_methods").glob("*.csv"))
    with open(part) as f:
        assert len(list(csv.DictReader(f))) == rows["all_methods"] == 3
    with pytest.raises(Exception, match="already exists"):
        results.write({"all_methods": found["all_methods"]}, str(tmp_path / "t"))
    doc = json.loads(results.document(found))
    assert len(doc["all_methods"]) == 3 and len(doc["confusion_matrices"]) == 105


def cloud(spark, path, n=60):
    las.register(spark)
    d = spark.createDataFrame([(i * 0.25, (i % 5) * 1.0, 2.0, (3, 5, 1, 0)[i % 4]) for i in range(n)], "x double, y double, z double, classification short")
    d.coalesce(1).write.format("las").option("path", path).option("scale", "0.25,0.25,0.25").mode("append").save()
    return las.paths_of(path)[0]


def test_final_gate_takes_stock_once(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    (root / "data" / "eval").mkdir(parents=True)
    os.rename(cloud(spark, str(tmp_path / "c")), root / "data" / "eval" / "a_gt.las")
    doc = {"regions": [{"id": "a", "source_candidate": "data/eval/a_gt.las", "scoring_bounds": [0, 0, 10, 5]}, {"id": "b", "source_candidate": "data/eval/b_gt.las", "scoring_bounds": [0, 0, 1, 1]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    cli.main(["gate", str(root), str(tmp_path / "p.json"), str(tmp_path / "gate")])
    a, b = json.loads(capsys.readouterr().out)
    assert a["codes"] == {"0": 10, "1": 10, "3": 10, "5": 10} and a["with_class"] == 20 and a["file_points"] == 60 and not a["eligible"] and b == {"region": "b", "candidate": "data/eval/b_gt.las", "bounds": [0, 0, 1, 1], "eligible": False, "exists": False}
    with pytest.raises(guard.Refused, match="before"):
        cli.main(["gate", str(root), str(tmp_path / "p.json"), str(tmp_path / "gate")])
    for path in ("data/a_gt.las", "data/eval/a.las", "../data/eval/a_gt.las"):
        with pytest.raises(guard.Refused):
            candidates.Candidate.of("x", path, [0, 0, 1, 1])
    os.symlink(root / "data" / "eval" / "a_gt.las", root / "data" / "eval" / "l_gt.las")
    with pytest.raises(guard.Refused, match="link"):
        candidates.inspect(spark, str(root), [candidates.Candidate.of("x", "data/eval/l_gt.las", [0, 0, 1, 1])])


def test_audit_suite(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, None), (3, 3.0)], "id int, v double")
    same, changed, other = candidates.audit_suite({"same": (a, a, "v"), "changed": (a, b, "v"), "other": (a, b.where("id < 3"), "v")}, ["id"])
    assert same["equal"] and same["changed"] == 0 and not changed["equal"] and (changed["changed"], changed["greatest_difference"]) == (1, 0.5) and not other["same_shape"]


def test_commands_for_tiles(spark, tmp_path, capsys):
    """Zones, annotation there and back, quality tables, evaluation."""
    tile = cloud(spark, str(tmp_path / "tile"))
    cli.main(["zones", tile, str(tmp_path / "zones"), "--run", "10"])
    assert spark.read.parquet(str(tmp_path / "zones")).count() == 6
    cli.main(["prepare", tile, str(tmp_path / "copy"), str(tmp_path / "m.json")])
    copy = spark.read.format("las").load(str(tmp_path / "copy"))
    edited = copy.drop("orig_index").where("tile_index % 3 = 0").withColumn("classification", F.lit(6).cast("short"))
    edited.coalesce(1).write.format("las").option("path", str(tmp_path / "edited")).option("scale", "0.25,0.25,0.25").mode("append").save()
    cli.main(["restore", tile, str(tmp_path / "edited"), str(tmp_path / "m.json"), str(tmp_path / "back")])
    back = spark.read.format("las").load(str(tmp_path / "back"))
    assert sorted(r.source_index for r in back.collect()) == list(range(0, 60, 3)) and back.select("classification").distinct().collect()[0][0] == 6
    cli.main(["evaluate", "--gt", tile, "--pred", tile])
    assert "1.0" in capsys.readouterr().out
    cli.main(["quality", tile, str(tmp_path / "q"), "0", "0", "8", "5"])
    assert {"density", "channels", "heights"} <= set(os.listdir(tmp_path / "q"))
