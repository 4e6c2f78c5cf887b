"""Prompt texts, experiment manifests, frozen modules."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from cellgrove.functions import text
from cellgrove.plans import guard, manifests
from cellgrove.sources.sinks import sha256_file


def test_texts_of_the_wrong_code_page():
    for good in ("é", "naïve café", "“quoted”", "日本語", "€ 5", "Größe", "ab"):
        bad = good.encode()
        for _ in range(2):
            want = text.repaired(good)
            wrong = "".join(next((c for c, b in text.CP1252.items() if b == x), chr(x)) for x in bad)
            assert text.repaired(wrong) == want
            bad = wrong.encode()
    for stays in ("Ã", "é", "été à", "Ñandú", "ÄÖÜ", ""):
        assert text.repaired(stays) == stays
    assert text.repaired("a\r\nb\rc\x00\ufeff") == "a\nb\nc" and text.repaired("é") == "é"


def test_cleanings(spark):
    rows = ["  A &amp;amp; B\t\n c ", "&lt;b&gt; Road_Sign!", "CafÃ©", None, "", "a {} b{c}", "x{}{}Y"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    of = lambda c: [r[0] for r in d.orderBy("i").select(c).collect()]
    assert of(text.clean(F.col("t"), "whitespace")) == ["A & B c", "<b> Road_Sign!", "Café", None, "", "a {} b{c}", "x{}{}Y"]
    assert of(text.clean(F.col("t"), "lower"))[:3] == ["a & b c", "<b> road_sign!", "café"]
    assert of(text.clean(F.col("t"), "canonicalize")) == ["a b c", "b road sign", "café", None, "", "a bc", "xy"]
    assert of(text.clean(F.col("t"), "canonicalize", "{}"))[5:] == ["a {} bc", "x{}{}y"]
    with pytest.raises(ValueError):
        text.clean(F.col("t"), "other")


@pytest.fixture
def study(tmp_path):
    for n in ("in.las", "src/a.py", "plans/base.json"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
    (tmp_path / "in.las").write_text("points")
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    base = {"parameters": {"window": 5, "band": 3.0}, "bounds": [0, 0, 4, 4], "inputs": {"in.las": sha256_file(str(tmp_path / "in.las"))}, "model": "m"}
    (tmp_path / "plans" / "base.json").write_text(json.dumps(base))
    (tmp_path / "p.json").write_text(json.dumps({"context": [0, 0, 10, 10], "protected": [[4, 4, 6, 6]]}))
    protocol = guard.Protocol.load(str(tmp_path / "p.json"), sha256_file(str(tmp_path / "p.json")))
    changes = {"narrow": {"band": 1.5}, "plain": {}}
    made = manifests.make(str(tmp_path), "plans/base.json", changes, ["src/a.py"], "plans", "runs")
    return tmp_path, protocol, changes, made


def test_manifests(study):
    root, protocol, changes, made = study
    assert made == ["plans/narrow.json", "plans/plain.json"]
    m = manifests.validate(str(root), made[0], changes, protocol, "runs")
    assert m["parameters"] == {"window": 5, "band": 1.5} and m["output"] == "runs/narrow"
    with pytest.raises(guard.Refused, match="already"):
        manifests.make(str(root), "plans/base.json", changes, ["src/a.py"], "plans", "runs")
    with pytest.raises(guard.Refused, match="base has not"):
        manifests.make(str(root), "plans/base.json", {"new": {"other": 1}}, ["src/a.py"], "plans", "runs")


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda m: m.update(experiment="free"), "registered"), (lambda m: m["parameters"].update(window=7), "registered change"), (lambda m: m.update(model="other"), "differ from the base"),
        (lambda m: m.update(bounds=[3, 3, 5, 5]), "differ"), (lambda m: m.update(output="elsewhere/narrow"), "new folder"), (lambda m: m.update(base_sha256="0" * 64), "base manifest has changed"),
        (lambda m: m["sources"].update({"src/a.py": "0" * 64}), "changed"), (lambda m: m.pop("sources"), "fields"),
    ],
)
def test_changed_manifests_are_refused(study, change, said):
    root, protocol, changes, made = study
    m = json.loads((root / made[0]).read_text())
    change(m)
    (root / made[0]).write_text(json.dumps(m))
    with pytest.raises(guard.Refused, match=said):
        manifests.validate(str(root), made[0], changes, protocol, "runs")


def test_changed_bytes_are_refused(study):
    root, protocol, changes, made = study
    (root / "runs" / "narrow").mkdir(parents=True)
    with pytest.raises(guard.Refused, match="new folder"):
        manifests.validate(str(root), made[0], changes, protocol, "runs")
    manifests.validate(str(root), made[1], changes, protocol, "runs")
    (root / "in.las").write_text("others")
    with pytest.raises(guard.Refused, match="changed"):
        manifests.validate(str(root), made[1], changes, protocol, "runs")


def test_frozen_modules(study, monkeypatch):
    root = study[0]
    monkeypatch.syspath_prepend(str(root / "src"))
    sys.modules.pop("a", None)
    import a

    digests = guard.manifest(str(root / "src"), ["a.py"])
    assert manifests.require_module(a, str(root / "src"), digests) is a
    with pytest.raises(guard.Refused, match="frozen"):
        manifests.require_module(a, str(root / "src"), {})
    for other in (json, types.ModuleType("nowhere")):
        with pytest.raises(guard.Refused, match="is not of"):
            manifests.require_module(other, str(root / "src"), digests)
    sys.modules.pop("a", None)
