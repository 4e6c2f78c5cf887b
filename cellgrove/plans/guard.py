"""Protocols that lock what may be read, and gates that open once."""

from __future__ import annotations

import json
import math
import os
import re
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from ..sources.sinks import create_json, sha256_file

HEX = re.compile(r"[0-9a-f]{64}")


class Refused(RuntimeError):
    """What a protocol, a gate or a manifest doesn't allow."""


def locked(path: str, digest: object, what: str) -> None:
    """Checks a file against the SHA-256 that it was locked with."""
    if not isinstance(digest, str) or HEX.fullmatch(digest) is None:
        raise Refused("a lock is a SHA-256 in lower-case hex")
    if sha256_file(path) != digest:
        raise Refused(f"{what} has changed")


class Rect(NamedTuple):
    """A rectangle; a tuple (x0, y0, x1, y1) that sorts and serialises as one."""

    x0: float
    y0: float
    x1: float
    y1: float

    @classmethod
    def of(cls, given: Sequence[float]) -> Rect:
        """From four finite numbers with positive extent."""
        plain = [float(v) for v in given if type(v) in (int, float) and math.isfinite(v)]
        if len(plain) != 4 or len(given) != 4 or not (plain[0] < plain[2] and plain[1] < plain[3]):
            raise Refused("a rectangle is four finite numbers with positive extent")
        return cls(*plain)

    def meets(self, other: Rect) -> bool:
        """Whether the two share a positive area; touching is none."""
        return not (self.x1 <= other.x0 or other.x1 <= self.x0 or self.y1 <= other.y0 or other.y1 <= self.y0)

    def holds(self, other: Rect) -> bool:
        corners = (self.x0 <= other.x0, self.y0 <= other.y0, other.x1 <= self.x1, other.y1 <= self.y1)
        return all(corners)


@dataclass(frozen=True)
class Protocol:
    """A JSON document {"context": bounds, "protected": [bounds, ...], "development": [bounds, ...]}, locked by its hash."""

    context: Rect
    protected: tuple[Rect, ...]
    development: tuple[Rect, ...]
    digest: str

    @classmethod
    def load(cls, path: str, digest: str) -> Protocol:
        locked(path, digest, "the protocol")
        with open(path) as f:
            doc = json.load(f)
        p = cls(Rect.of(doc["context"]), tuple(map(Rect.of, doc["protected"])), tuple(map(Rect.of, doc.get("development", []))), digest)
        for b in (*p.protected, *p.development):
            if not p.context.holds(b):
                raise Refused("a rectangle leaves the context")
        for b in p.development:
            p.require_free(b)
        return p

    def require_free(self, bounds: Sequence[float]) -> Rect:
        """The bounds, if they share no area with a protected rectangle."""
        b = Rect.of(bounds)
        if any(b.meets(x) for x in self.protected):
            raise Refused("the rectangle is protected")
        return b


@dataclass(frozen=True)
class Gate:
    """An evaluation that may begin once: began.json is created exclusively, and finished.json only after it."""

    folder: str

    def begin(self, record: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        try:
            create_json(os.path.join(self.folder, "began.json"), record)
        except FileExistsError:
            raise Refused("the gate has been opened before") from None

    def finish(self, record: dict) -> None:
        began = os.path.join(self.folder, "began.json")
        if not os.path.exists(began):
            raise Refused("the gate was not opened")
        try:
            create_json(os.path.join(self.folder, "finished.json"), record | {"began_sha256": sha256_file(began)})
        except FileExistsError:
            raise Refused("the gate has been closed before") from None


def inside_folder(root: str, relative: str) -> str:
    """The path of a relative name that stays under root."""
    path = os.path.realpath(os.path.join(root, relative))
    if os.path.isabs(relative) or not path.startswith(os.path.realpath(root) + os.sep):
        raise Refused(f"{relative} leaves its folder")
    return path


def manifest(root: str, names: list[str]) -> dict[str, str]:
    return {n: sha256_file(inside_folder(root, n)) for n in sorted(names)}


def verify_manifest(root: str, wanted: dict[str, str]) -> None:
    for n, digest in wanted.items():
        locked(inside_folder(root, n), digest, n)


def require_same(wanted: set[str], found: set[str], what: str) -> None:
    if wanted != found:
        raise Refused(f"{what}: missing {sorted(wanted - found)[:5]}, unexpected {sorted(found - wanted)[:5]}")


def require_committed(repository: str, names: list[str]) -> None:
    """Checks that the files are, byte for byte, those of the last commit."""
    for n in names:
        path = inside_folder(repository, n)
        kept = subprocess.run(["git", "-C", repository, "show", f"HEAD:{n}"], capture_output=True)
        with open(path, "rb") as f:
            if kept.returncode or kept.stdout != f.read():
                raise Refused(f"{n} is not committed as it is")


@dataclass(frozen=True)
class BoundedRun:
    """One evaluation of a development rectangle: bounds checked against the protocol, inputs hashed before anything is
    read, outputs new, and a record of all of it written once."""

    protocol: Protocol
    bounds: Rect
    inputs: dict[str, str]
    folder: str

    @classmethod
    def prepare(cls, protocol: Protocol, bounds: Sequence[float], inputs: dict[str, str], folder: str) -> BoundedRun:
        run = cls(protocol, protocol.require_free(bounds), inputs, folder)
        if not protocol.context.holds(run.bounds):
            raise Refused("the rectangle leaves the context")
        for path, digest in inputs.items():
            locked(path, digest, path)
        os.makedirs(folder, exist_ok=False)
        return run

    def record(self, outputs: list[str], settings: dict) -> None:
        create_json(os.path.join(self.folder, "manifest.json"), {"protocol": self.protocol.digest, "bounds": self.bounds, "inputs": self.inputs, "outputs": manifest(self.folder, outputs), "settings": settings})

    def run(self, label: Callable[[], dict[str, str]], score: Callable[[], dict], settings: dict) -> dict:
        """Labels, then scores, then records: label writes the outputs and names them, score's figures are kept."""
        outputs = sorted(label().values())
        figures = score()
        self.record(outputs, settings | {"scores": figures})
        return figures


def inventory(folder: str, suffix: str = ".json") -> dict[str, str]:
    """The candidates of a final gate: every file of that kind under the folder with its digest, by relative name."""
    names = [os.path.relpath(os.path.join(at, n), folder) for at, _, ns in os.walk(folder) for n in ns if n.endswith(suffix)]
    return manifest(folder, names)


def require_provenance(record: dict, inputs: dict[str, str], identity: str) -> None:
    """Checks a response's record: made from these inputs (name: digest), by the model of this identity."""
    if record.get("identity") != identity:
        raise Refused("another model made the response")
    require_same(set(inputs.items()), set(dict(record.get("inputs", {})).items()), "inputs")
