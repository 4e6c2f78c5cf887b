"""Manifests of one-factor experiments: written once from a recorded base, checked before anything is read."""

from __future__ import annotations

import copy
import json
import os
from types import ModuleType

from ..sources.sinks import create_json, sha256_file
from .guard import Protocol, Refused, inside_folder, locked, manifest, require_same, verify_manifest

#: What a manifest holds besides the settings it has from its base.
OWN = ("experiment", "base", "base_sha256", "sources", "output")


def _load(root: str, name: str) -> dict:
    with open(inside_folder(root, name)) as f:
        return json.load(f)


def make(root: str, base: str, changes: dict[str, dict], sources: list[str], folder: str, outputs: str) -> list[str]:
    """A new manifest folder/name.json for each named change of the base's parameters; none if one is there already.

    base: a JSON file with parameters, bounds and inputs (name: SHA-256), whose inputs must be as recorded. sources: the
    files whose bytes every experiment depends on. Each output is a folder of its own under `outputs`.
    """
    recorded = _load(root, base)
    verify_manifest(root, recorded["inputs"])
    names = {n: os.path.join(folder, f"{n}.json") for n in changes}
    if there := [p for p in names.values() if os.path.exists(inside_folder(root, p))]:
        raise Refused(f"{there[0]} is there already")
    digests = manifest(root, sources)
    for n, change in changes.items():
        if unknown := set(change) - set(recorded["parameters"]):
            raise Refused(f"{n} changes parameters that the base has not: {sorted(unknown)}")
        m = copy.deepcopy(recorded)
        m["parameters"] |= change
        m |= {"experiment": n, "base": base, "base_sha256": sha256_file(inside_folder(root, base)), "sources": digests, "output": os.path.join(outputs, n)}
        create_json(inside_folder(root, names[n]), m)
    return sorted(names.values())


def validate(root: str, name: str, registered: dict[str, dict], protocol: Protocol, outputs: str) -> dict:
    """The manifest, if it is one registered change of its base and all it names is as it was.

    Refused are: an experiment that isn't registered, other parameters than the base's with that change, settings that
    differ from the base, bounds that the protocol protects or doesn't hold, an output elsewhere or already there, and
    a base, input or source whose bytes have changed.
    """
    m = _load(root, name)
    require_same({*OWN, "parameters", "bounds", "inputs"}, set(m) & {*OWN, "parameters", "bounds", "inputs"}, "fields")
    if m["experiment"] not in registered:
        raise Refused(f"{m['experiment']} is not registered")
    locked(inside_folder(root, m["base"]), m["base_sha256"], "the base manifest")
    base = _load(root, m["base"])
    if m["parameters"] != base["parameters"] | registered[m["experiment"]]:
        raise Refused("the parameters are not the base's with the registered change")
    if {k: v for k, v in m.items() if k not in OWN and k != "parameters"} != {k: v for k, v in base.items() if k != "parameters"}:
        raise Refused("settings differ from the base")
    if not protocol.context.holds(protocol.require_free(m["bounds"])):
        raise Refused("the bounds leave the context")
    if os.path.dirname(m["output"]) != outputs or os.path.exists(inside_folder(root, m["output"])):
        raise Refused("the output must be a new folder of its own")
    verify_manifest(root, m["inputs"])
    verify_manifest(root, m["sources"])
    return m


def require_module(module: ModuleType, root: str, digests: dict[str, str]) -> ModuleType:
    """The module, if every place it was loaded from lies under root and, as a file, has its digest (by relative name).

    What a worker imported before, or from elsewhere, is no frozen source.
    """
    file = getattr(module, "__file__", None)
    places = [file] if file else list(getattr(module, "__path__", []))
    top = os.path.realpath(root) + os.sep
    if not places or any(not os.path.realpath(p).startswith(top) for p in places):
        raise Refused(f"{module.__name__} is not of {root}")
    if file:
        relative = os.path.relpath(os.path.realpath(file), os.path.realpath(root))
        if digests.get(relative) != sha256_file(file):
            raise Refused(f"{relative} is not the frozen source")
    return module
