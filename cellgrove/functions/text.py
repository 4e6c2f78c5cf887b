"""Cleaning of prompt texts: entities, texts decoded by the wrong code page, punctuation with exceptions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clean_whitespace

# The characters of Windows code page 1252 in 128-159, by their byte.
CP1252 = {bytes([b]).decode("cp1252", "replace"): b for b in range(128, 160) if bytes([b]).decode("cp1252", "replace") != "\ufffd"}
_BYTE = {chr(b): b for b in range(128, 256)} | CP1252
_HIGH = "".join(map(re.escape, _BYTE))
_RUN = re.compile(f"[{_HIGH}]{{2,}}")
_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'})
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff]")


def _again(m: re.Match) -> str:
    """A run of high characters as UTF-8, if its bytes in the one-byte code page are that."""
    try:
        return bytes(_BYTE[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repaired(text: str) -> str:
    """A text with what was decoded by the wrong code page read as UTF-8 again, until nothing changes; straight quotes,
    one form of line end, no control characters, composed letters. Runs that aren't UTF-8 stay."""
    for _ in range(4):
        new = _RUN.sub(_again, text)
        if new == text:
            break
        text = new
    return unicodedata.normalize("NFC", _CONTROL.sub("", text.translate(_QUOTES).replace("\r\n", "\n").replace("\r", "\n")))


def basic(text: Column) -> Column:
    """Repaired, entities resolved twice (as texts of the web are often escaped twice), trimmed; null stays null."""

    def every(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else html.unescape(html.unescape(repaired(t))).strip())

    return F.pandas_udf(every, "string")(text)


def canonical(text: Column, keep: str | None = None) -> Column:
    """Lower case without ASCII punctuation (underscores are spaces), spaces collapsed; occurrences of `keep` stay as they are."""
    bare = lambda c: F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")
    spaced = F.translate(text, "_", " ")
    plain = bare(spaced) if not keep else F.array_join(F.transform(F.split(spaced, re.escape(keep), -1), bare), keep)
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def clean(text: Column, kind: str, keep: str | None = None) -> Column:
    """One of the three cleanings: whitespace, lower, canonicalize."""
    c = basic(text)
    if kind == "canonicalize":
        return canonical(c, keep)
    if kind not in ("lower", "whitespace"):
        raise ValueError(f"unknown cleaning {kind}")
    return F.lower(clean_whitespace(c)) if kind == "lower" else clean_whitespace(c)
