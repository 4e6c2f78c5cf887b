"""Coordinate-system texts (WKT 1 and 2) as a tree of brackets, and what a survey must know of them: axes, units, datum."""

from __future__ import annotations

import re
from dataclasses import dataclass


class WktError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?![\w])|(?P<word>\w+)|(?P<mark>[\[\](),]))')
COMPOUND, PROJECTED = {"COMPD_CS", "COMPOUNDCRS"}, {"PROJCS", "PROJCRS", "PROJECTEDCRS", "LOCAL_CS", "ENGCRS", "ENGINEERINGCRS"}
GEOGRAPHIC, VERTICAL = {"GEOGCS", "GEOGCRS", "GEOGRAPHICCRS", "GEODCRS", "GEODETICCRS", "GEOCCS"}, {"VERT_CS", "VERTCRS", "VERTICALCRS"}
WRAPPED, UNITS = {"BOUNDCRS": "SOURCECRS", "COORDINATEMETADATA": None}, {"UNIT", "LENGTHUNIT", "ANGLEUNIT"}
DATUMS = {"VERT_DATUM", "VDATUM", "VRF", "VERTICALDATUM"}


@dataclass(frozen=True)
class Node:
    """KEYWORD[...]: name in capitals; parts are texts, numbers, plain words (as Node without parts) and further nodes."""

    name: str
    parts: tuple = ()

    def nodes(self, names: set[str]) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and p.name in names]

    @property
    def title(self) -> str | None:
        return next((p for p in self.parts if isinstance(p, str)), None)


def parse(text: str) -> Node:
    """The tree of one text; anything unreadable is an error. Systems side by side, with commas between, are compound."""
    at, stack, roots, word, more = 0, [], [], None, True  # stack: [name, parts]; more: whether another root may follow

    def close(node: Node) -> None:
        nonlocal more
        if stack:
            stack[-1][1].append(node)
        elif not more:
            raise WktError("more than one coordinate system")
        else:
            roots.append(node)
            more = False

    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise WktError(f"unreadable at {text[at : at + 20]!r}")
        at, mark = m.end(), m["mark"]
        if mark in ("[", "("):
            if word is None:
                raise WktError("a bracket without a keyword")
            stack.append([word, []])
            word = None
            continue
        if word is not None:
            close(Node(word))
            word = None
        if m["word"]:
            word = m["word"].upper()
        elif mark in ("]", ")"):
            if not stack:
                raise WktError("a bracket too many is closed")
            name, parts = stack.pop()
            close(Node(name, tuple(parts)))
        elif mark == ",":
            more = more or not stack
        else:
            if not stack:
                raise WktError("a value outside of brackets")
            stack[-1][1].append(m["text"][1:-1].replace('""', '"') if m["text"] else float(m["number"]))
    if stack or word or not roots:
        raise WktError("the text ends early")
    return roots[0] if len(roots) == 1 else Node("COMPD_CS", tuple(roots))


@dataclass(frozen=True)
class Axis:
    name: str | None
    direction: str | None
    unit: str | None
    factor: float | None  # of metres, or of radians for angles


@dataclass(frozen=True)
class System:
    """title; axes of the horizontal part, then of the vertical one; vertical: whether there is such a part."""

    title: str | None
    geographic: bool
    axes: tuple[Axis, ...]
    vertical: bool
    vertical_datums: tuple[str, ...]


def _axes(crs: Node, default: int) -> list[Axis]:
    """The axes of one part. A unit of an axis goes before that of its part; a part that names no axis has `default`."""
    unit = lambda n: next(((u.title, next((float(p) for p in u.parts if isinstance(p, float)), None)) for u in n.nodes(UNITS)), None)
    common, named = unit(crs), crs.nodes({"AXIS"})
    out = []
    for a in named:
        words = [p.name.lower() for p in a.parts if isinstance(p, Node) and not p.parts]
        out.append(Axis(a.title, words[0] if words else None, *(unit(a) or common or (None, None))))
    return out or [Axis(None, None, *(common or (None, None)))] * default


def system(text: str) -> System:
    """Reads a coordinate system: projected or local, geographic, vertical, or compound of these."""
    root = parse(text)
    while root.name in WRAPPED:
        inner = [n for n in root.parts if isinstance(n, Node) and n.parts and (WRAPPED[root.name] in (None, n.name))]
        if not inner:
            raise WktError(f"{root.name} holds no coordinate system")
        root = inner[0] if WRAPPED[root.name] is None else next(n for n in inner[0].parts if isinstance(n, Node))
    parts = [n for n in root.parts if isinstance(n, Node) and n.name in PROJECTED | GEOGRAPHIC | VERTICAL | COMPOUND] if root.name in COMPOUND else [root]
    axes, datums, vertical, geographic = [], [], False, False
    for p in parts:
        if p.name in VERTICAL:
            vertical = True
            axes += _axes(p, 1)
            datums += [d.title.strip() for d in p.nodes(DATUMS) if d.title and d.title.strip().lower() not in ("", "unknown", "unnamed")]
        elif p.name in PROJECTED or p.name in GEOGRAPHIC:
            geographic |= p.name in GEOGRAPHIC
            axes += _axes(p, 2)
        else:
            raise WktError(f"{p.name} is no coordinate system that is known here")
    return System(root.title, geographic, tuple(axes), vertical, tuple(dict.fromkeys(datums)))
