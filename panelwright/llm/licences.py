"""Licence scan by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of every licence template and base phrase. A text is
streamed through it word by word: the state tells the longest run that ends here and occurs in
some template. For each template, the runs that can grow no further in it, though the text may go
on like another one, and that are long enough are chained, in template order, into spans; a span
that covers enough of its template carries the template's label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ascii_lower, pieces
from panelwright.llm.licence_texts import WHOLE

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BETWEEN = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]")

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings and notices of public licence texts by label, and whole texts.
TEMPLATES = {
    "mit_text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software",
        "Released under the MIT License",
    ],
    "apache_text": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl_text": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "bsd_text": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "isc_text": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl_text": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "cc_by_nc_text": ["Licensed under CC BY-NC 4.0"],
    "cc_by_sa_text": ["Licensed under CC BY-SA 4.0"],
    "cc_by_text": ["Licensed under CC BY 4.0"],
    **WHOLE,
}


class Automaton:
    """Generalised suffix automaton over words."""

    def __init__(self, phrases: list[tuple[str, list[str]]]):
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        self.sizes = [len(p) for _, p in phrases]
        self.labels = [label for label, _ in phrases]
        coded = [[self.words.setdefault(w, len(self.words)) for w in p] for _, p in phrases]
        for p in coded:
            last = 0
            for c in p:
                last = self._extend(last, c)
        for t, p in enumerate(coded):
            at = 0
            for i, c in enumerate(p):
                at = self.next[at][c]
                state = at
                while state > 0 and t not in self.ends[state]:
                    self.ends[state][t] = i
                    state = self.link[state]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """State reached from ``p`` by ``c`` whose longest run is one word longer than p's."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def state_of(self, phrase: list[str]) -> int:
        state = 0
        for w in phrase:
            state = self.next[state][self.words[w]]
        return state


def split_words(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


class Scanner:
    """Base phrases, and template spans of at least ``coverage``, of one text after another."""

    def __init__(self, coverage: float, least: int, gap: int):
        self.coverage, self.least, self.gap = coverage, least, gap
        base = [(label, split_words(p)) for p, label in BASE.items()]
        texts = [(label, split_words(t)) for label, own in TEMPLATES.items() for t in own]
        self.auto = Automaton(base + texts)
        self.n_base = len(base)
        # Base phrases that end in a state: its own and those of its suffixes.
        own = {self.auto.state_of(p): (label, len(p)) for label, p in base}
        self.hits: list[list[tuple[str, int]]] = []
        for state in range(len(self.auto.length)):
            found, s = [], state
            while s > 0:
                if s in own:
                    found.append(own[s])
                s = self.auto.link[s]
            self.hits.append(found)
        # Of each state and template, the longest run that ends there and is in the template:
        # (template, place of its last word, state); it is the state's own or one of its suffixes'.
        self.runs: list[list[tuple[int, int, int]]] = []
        for state in range(len(self.auto.length)):
            nearest, s = {}, state
            while s > 0:
                for t, at in self.auto.ends[s].items():
                    if t >= self.n_base and t not in nearest:
                        nearest[t] = (t, at, s)
                s = self.auto.link[s]
            self.runs.append([r for r in nearest.values() if self.auto.length[r[2]] >= min(self.least, self.auto.sizes[r[0]])])
        self.over: dict[tuple[int, int | None], list[tuple[int, int, int]]] = {}

    def _ended(self, state: int, c: int | None) -> list[tuple[int, int, int]]:
        """Those of a state's runs that don't go on in their own template with the word ``c``."""
        found = self.over.get((state, c))
        if found is None:
            following, ends = self.auto.next, self.auto.ends
            found = [r for r in self.runs[state] if c not in following[r[2]] or r[0] not in ends[following[r[2]][c]]]
            self.over[state, c] = found
        return found

    def _chain(self, open_: dict, spans: list, end: int, longest: int, state: int, c: int | None) -> None:
        for t, at, own in self._ended(state, c):
            length = longest if own == state else self.auto.length[own]
            if length < min(self.least, self.auto.sizes[t]):
                continue
            begin = end - length + 1
            span = open_.get(t)
            if span:
                new = min(length, end - span[1], at - span[2])
                if new > 0 and begin - span[1] <= self.gap:
                    span[1:] = [end, at, span[3] + new]
                    continue
                self._close(t, span, spans)
            open_[t] = [begin, end, at, length]

    def _close(self, t: int, span: list, spans: list) -> None:
        share = min(1.0, span[3] / self.auto.sizes[t])
        if share >= self.coverage:
            spans.append((self.auto.labels[t], span[0], span[1] + 1, share))

    def scan(self, text: str | None) -> tuple:
        """``n_words, base [(label, start)], spans [(label, start, stop, coverage)]``."""
        code, following, link, size = self.auto.words.get, self.auto.next, self.auto.link, self.auto.length
        hits, runs, base, spans, open_ = self.hits, self.runs, [], [], {}
        state = length = 0
        n = 0
        for piece in pieces(text or "", BETWEEN):
            words = split_words(piece)
            for i, word in enumerate(words, n):
                c = code(word)
                if runs[state]:
                    self._chain(open_, spans, i - 1, length, state, c)
                if c is None:
                    state = length = 0
                    continue
                if c not in following[state]:
                    while state and c not in following[state]:
                        state = link[state]
                        length = size[state]
                    if c not in following[state]:
                        continue
                state = following[state][c]
                length += 1
                if hits[state]:
                    base += [(label, i - k + 1) for label, k in hits[state] if length >= k]
            n += len(words)
        self._chain(open_, spans, n - 1, length, state, None)
        for t, span in open_.items():
            self._close(t, span, spans)
        return n, base, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


FOUND = (
    "n_words long, base array<struct<label:string,start:long>>, "
    "spans array<struct<label:string,start:long,stop:long,coverage:double>>"
)


def scan_licences(
    docs: DataFrame, text: str, out: str = "licences", coverage: float = 0.6, least: int = 4, gap: int = 8
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``base`` (each place of a base phrase) and ``spans``.

    A run counts towards a span from ``least`` words (or the whole template); runs of a span lie
    at most ``gap`` words apart and follow the template's order; a span is kept if they cover
    ``coverage`` of the template. Starts count words from 0, stops are exclusive; spans of
    several templates may overlap. Null and empty texts have no words and no places. Texts are
    streamed, so very long ones need no more memory than their piece of a megabyte; an empty
    table stays empty; repeated rows repeat their result; other columns pass through, and a
    column named ``out`` is replaced. Rows are scanned where they are read: no shuffle.
    """

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(coverage, least, gap)
        for part in parts:
            yield pd.DataFrame([scanner.scan(t) for t in part], columns=["n_words", "base", "spans"])

    return docs.withColumn(out, found(F.col(text)))
