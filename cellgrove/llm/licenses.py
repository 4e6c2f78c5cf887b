"""Licence scans: matching statistics of a generalised suffix automaton of licence texts, chained into template spans.

Texts are streamed word by word, a bounded piece at a time. Words, and pairs of neighbouring words, that no template has
can't be part of a match of two words or more, so the automaton only reads the stretches whose neighbours all occur as
pairs; everything else restarts it. That changes no match.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels, and openings and notices of public licence texts.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("reserved", "all rights reserved"),
]
#: A match is long from LONG words, or where it is a whole template; a chain's matches lie within GAP words in the text.
LONG, GAP = 4, 8
#: The share of a template's words that a chain must cover to give its label.
COVER = 0.6
PIECE = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, about `size` bytes at a time; no word is cut."""
    at, edge = 0, re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
    while at < len(text):
        m = edge.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        yield words_of(text[at:end])
        at = end


class Span(NamedTuple):
    label: str
    first: int
    last: int
    covered: int
    template_words: int


class Automaton:
    """A generalised suffix automaton of word sequences: one state for each set of factors with equal end places.

    step, link, length: transitions, suffix links and longest factors of the states; ends: the (template, end) places of
    a state's factors, for those that a long match can be in; stops: the templates that are suffixes of a state's longest.
    """

    def __init__(self, phrases: Iterable[tuple[str, str]] = PHRASES, templates: Iterable[tuple[str, str]] = TEMPLATES, long: int = LONG):
        texts = [(label, words_of(t.encode()), base) for base, group in ((True, phrases), (False, templates)) for label, t in group]
        if short := [t[0] for t in texts if len(t[1]) < 2]:
            raise ValueError(f"templates of under two words: {short}")
        self.labels, self.sizes, self.base = [t[0] for t in texts], [len(t[1]) for t in texts], [t[2] for t in texts]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for _, ws, _ in texts for w in ws}))}
        coded = [[self.ids[w] for w in ws] for _, ws, _ in texts]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tops = [self._add(ws) for ws in coded]
        self.pairs = np.zeros((len(self.ids) + 1, len(self.ids) + 1), bool)
        for ws in coded:
            self.pairs[ws[:-1], ws[1:]] = True
        self.least = min([long, *(n for n, base in zip(self.sizes, self.base) if not base)])
        places: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for t, states in enumerate(tops):
            for end, s in enumerate(states):
                while s > 0 and (t, end + 1) not in places[s] and self.length[s] >= min(long, self.sizes[t]):
                    places[s].add((t, end + 1))
                    s = self.link[s]
        self.ends = [sorted(p) for p in places]
        whole: dict[int, tuple[int, ...]] = {}
        for t, states in enumerate(tops):
            whole[states[-1]] = whole.get(states[-1], ()) + (t,)
        self.stops: list[tuple[int, ...]] = [()] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.stops[s] = self.stops[self.link[s]] + whole.get(s, ())
        self.long = long

    def _add(self, ws: list[int]) -> list[int]:
        """Adds a sequence, beginning at the root; the state of each of its prefixes."""
        last, out = 0, []
        for w in ws:
            q = self.step[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
            else:
                new = len(self.step)
                self.step.append({})
                self.length.append(self.length[last] + 1)
                self.link.append(0)
                p = last
                while p >= 0 and w not in self.step[p]:
                    self.step[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
                last = new
            out.append(last)
        # a later clone takes over the shorter factors of a state, never a whole prefix, so these states stay right
        return out

    def _clone(self, p: int, q: int, w: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def statistics(self, coded: Iterable[int], state: int = 0, length: int = 0) -> Iterator[tuple[int, int]]:
        """For each word (0: unknown) the state and length of the longest factor that ends with it."""
        step, link, lengths = self.step, self.link, self.length
        for w in coded:
            while state and w not in step[state]:
                state = link[state]
                length = lengths[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            yield state, length


class Scan(NamedTuple):
    n_words: int
    places: list[tuple[int, int]]
    spans: list[Span]


class Reader:
    """Reads a text piece by piece and keeps base phrases (phrase, start), whole templates (template, start) and
    right-maximal long matches (start, length, state); of the words read it keeps the last one and its match."""

    def __init__(self, a: Automaton):
        self.a, self.n_words = a, 0
        self.places: list[tuple[int, int]] = []
        self.wholes: list[tuple[int, int]] = []
        self.matches: list[tuple[int, int, int]] = []
        self._last, self._at = 0, (0, 0)  # the last word's id, its state and length

    def _ended(self, at: tuple[int, int], next_word: int) -> None:
        if at[1] >= self.a.least:
            self.matches.append((next_word - at[1], at[1], at[0]))

    def feed(self, words: list[bytes]) -> None:
        a, ids = self.a, self.a.ids.get
        coded = np.fromiter((self._last, *(ids(w, 0) for w in words)), np.int32, len(words) + 1)
        linked = a.pairs[coded[:-1], coded[1:]]
        edge = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
        runs = [(b, e + 1) for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
        first = self.n_words - 1  # the text's place of coded[0]
        if not runs or runs[0][0] > 0:
            self._ended(self._at, self.n_words)
        for b, e in runs:
            at, i = (self._at, b + 1) if b == 0 else ((0, 0), b)
            for now in a.statistics(coded[i:e].tolist(), *at):
                if now[1] <= at[1]:
                    self._ended(at, first + i)
                at, i = now, i + 1
                for t in a.stops[at[0]]:
                    if a.sizes[t] <= at[1]:
                        (self.places if a.base[t] else self.wholes).append((t, first + i - a.sizes[t]))
            if e < len(coded):
                self._ended(at, first + e)
        if runs and runs[-1][1] == len(coded):
            self._at = at
        elif len(words):
            state = a.step[0].get(int(coded[-1]), 0)
            self._at = (state, int(state > 0))
        self._last, self.n_words = int(coded[-1]), self.n_words + len(words)

    def end(self) -> None:
        self._ended(self._at, self.n_words)
        self._last, self._at = 0, (0, 0)


def scan(text: bytes, a: Automaton, piece: int = PIECE, cover: float = COVER) -> Scan:
    """The words of a text, its base phrases as (phrase, start), and the spans that cover enough of a template."""
    r = Reader(a)
    for words in pieces(text, piece):
        if words:
            r.feed(words)
    r.end()
    return Scan(r.n_words, sorted(r.places, key=lambda p: (p[1], p[0])), chains(r.matches, r.wholes, a, cover))


def chains(matches: list[tuple[int, int, int]], wholes: list[tuple[int, int]], a: Automaton, cover: float = COVER, gap: int = GAP) -> list[Span]:
    """For each template the chains of its matches, ascending in text and template and at most `gap` words apart, that
    cover at least the share `cover` of its words; of chains that overlap in the text only the best stays.

    A long match counts for the templates that hold all of it, so a passage that one template has further than another
    is that one's. Templates that occur as a whole always count.
    """
    by: dict[int, list[tuple[int, int, int]]] = {}
    for t, start in wholes:
        by.setdefault(t, []).append((start, 0, a.sizes[t]))
    for start, length, state in matches:
        for t, end in a.ends[state]:
            if not a.base[t]:
                if length >= min(a.long, a.sizes[t]):
                    by.setdefault(t, []).append((start, end - length, length))
    out = []
    for t, found in by.items():
        found = sorted(set(found))
        best: list[tuple[int, int]] = []  # words covered up to and with this match, first word of its chain
        for j, (start, at, k) in enumerate(found):
            most, i = (k, start), j - 1
            while i >= 0 and start - found[i][0] <= gap + a.sizes[t]:
                s, p, m = found[i]
                shared = max(0, s + m - start, p + m - at)  # words of this match that the other has already
                if s < start and p < at and shared < k and start - (s + m) <= gap:
                    most = max(most, (best[i][0] + k - shared, best[i][1]), key=lambda x: (x[0], -x[1]))
                i -= 1
            best.append(most)
        ranked = sorted(((c, -first, start + k - 1) for (c, first), (start, _, k) in zip(best, found) if c >= cover * a.sizes[t]), reverse=True)
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for c, first, last in ranked:
            i = bisect(taken, (-first, last))
            if (i == 0 or taken[i - 1][1] < -first) and (i == len(taken) or last < taken[i][0]):
                taken.insert(i, (-first, last))
                out.append(Span(a.labels[t], -first, last, c, a.sizes[t]))
    return sorted(out, key=lambda s: (s.first, s.last, s.label, s.template_words))


SCHEMA = "n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,first:long,last:long,covered:int,template_words:int>>"


def scan_texts(docs: DataFrame, automaton: Automaton | None = None, cover: float = COVER) -> DataFrame:
    """doc_id with n_words, places (base phrases: label and first word) and spans of every row, in one pass.

    A null text counts as empty: no words, no places, no spans. Repeated rows, equal and null doc_ids give a row each;
    an empty table gives none. Texts of any length are read a piece at a time; what is kept of one are its base places
    and long matches. Spans of different templates may overlap. Further columns are ignored. The automaton, whose size
    is that of its templates, goes to every task.
    """
    given = docs.sparkSession.sparkContext.broadcast(automaton or Automaton())

    def run(batches):
        a = given.value
        for b in batches:
            found = [scan(t.as_py() or b"", a, cover=cover) for t in b.column(1)]
            places = [[{"label": a.labels[t], "start": i} for t, i in s.places] for s in found]
            spans = [[x._asdict() for x in s.spans] for s in found]
            kinds = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int32()), ("template_words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.n_words for s in found], pa.int64()), pa.array(places, kinds[0]), pa.array(spans, kinds[1])], names=["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id long, {SCHEMA}")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the greatest share of a template found)."""
    joined = lambda *names: F.array_join(F.array_sort(F.array_distinct(F.concat(*names))), ",")
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    share: Column = F.array_max(F.transform("spans", lambda s: s["covered"] / s["template_words"]))
    whole = F.when(F.size("places") > 0, 1.0)
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(base, F.transform("spans", lambda s: s["label"])).alias("labels"), F.coalesce(F.greatest(whole, share), F.lit(0.0)).alias("score"))
