"""Benchmark passages in documents by the q-gram lemma and banded alignment.

A passage is cut into overlapping windows. A copy of a window of m characters with at most e
edits shares at least m - q + 1 - q * e of its q-grams, all within e diagonals of each other.
Shared q-grams are therefore counted per window in overlapping bands of diagonals; bands that
reach the bound are regions, and a banded alignment settles each region exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: Diagonals between the starts of two bands; more than any edit budget.
BAND = 16
#: Characters of passages that one broadcast holds; more passages take more passes.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True


def characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, each run of blanks as one space, and where each stood."""
    low = text.lower()
    # Letters that lower to several characters stay as they are, so that places hold.
    text = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if text.isascii():
        chars = np.frombuffer(text.encode(), np.uint8)
        blank = BLANKS[chars]
    else:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        blank = BLANKS[np.minimum(chars, 255)]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep):
        keep[0] = True
    return np.where(blank, chars.dtype.type(32), chars)[keep], np.flatnonzero(keep)


def grams(chars: np.ndarray) -> np.ndarray:
    """All q-grams as 64-bit codes, one byte a character; equal q-grams have equal codes."""
    if len(chars) < Q:
        return np.empty(0, np.uint64)
    if chars.dtype != np.uint8:
        folded = (chars * np.uint32(2654435761)) >> np.uint32(24)
        chars = np.where(chars < 256, chars, folded).astype(np.uint8)
    return np.ndarray(len(chars) - Q + 1, "<u8", np.ascontiguousarray(chars).tobytes(), strides=(1,)).copy()


def spots(codes: np.ndarray) -> np.ndarray:
    return (codes * SPREAD >> np.uint64(64 - TABLE_BITS)).astype(np.intp)


@dataclass
class Windows:
    """Windows of all passages, their budgets, and where each q-gram stands in them."""

    item: np.ndarray
    chars: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(passages: list[tuple[object, str]], width: int, rate: float) -> Windows:
        item, chars, budget = [], [], []
        for name, text in passages:
            whole = characters(text or "")[0].astype(np.uint32)
            whole = whole[int(whole[:1].sum() == 32):len(whole) - int(whole[-1:].sum() == 32)]
            if len(whole) < Q:
                continue
            size = min(width, len(whole))
            for at in dict.fromkeys([*range(0, len(whole) - size + 1, max(1, width // 2)), len(whole) - size]):
                item.append(name)
                chars.append(whole[at:at + size])
                budget.append(min(int(rate * size), (size - Q) // Q, BAND - 1))
        codes = [grams(c) for c in chars]
        window = np.repeat(np.arange(len(chars)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes] or [np.empty(0, np.int64)])
        flat = np.concatenate(codes or [np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        held = np.zeros(1 << TABLE_BITS, bool)
        held[spots(distinct)] = True
        sizes = np.array([len(c) for c in chars], np.int64)
        budget = np.array(budget, np.int64)
        return Windows(np.array(item, object), chars, budget, sizes - Q + 1 - Q * budget, distinct,
                       np.append(first, len(flat)), window[order], offset[order], held)

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands that share enough q-grams with them."""
        codes = grams(text)
        at = np.flatnonzero(self.held[spots(codes)])
        found = np.searchsorted(self.codes, codes[at])
        real = self.codes[np.minimum(found, len(self.codes) - 1)] == codes[at] if len(self.codes) else np.zeros(0, bool)
        at, found = at[real], found[real]
        number = self.first[found + 1] - self.first[found]
        entry = np.repeat(self.first[found] - np.cumsum(number) + number, number) + np.arange(number.sum())
        window, diagonal = self.window[entry], np.repeat(at, number) - self.offset[entry]
        band = diagonal // BAND
        # A band also takes the first diagonals of the next, as many as the window has edits.
        over = diagonal - band * BAND < self.budget[window]
        base, bands = -(1 << 16), np.int64(1 << 40)
        key = np.concatenate([window * bands + band - base, window[over] * bands + band[over] - 1 - base])
        key, shared = np.unique(key, return_counts=True)
        window, band = key // bands, key % bands + base
        enough = shared >= self.need[window]
        return window[enough], band[enough] * BAND

    def aligned(self, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``window, start, stop, edits`` of the regions that align within their budget."""
        out = []
        for size in np.unique([len(self.chars[w]) for w in window]):
            own = np.array([len(self.chars[w]) == size for w in window])
            for at in range(0, own.sum(), 256):
                out += self._align(text, window[own][at:at + 256], diagonal[own][at:at + 256], int(size))
        return out

    def _align(self, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
        width = BAND + int(self.budget[window].max())
        pattern = np.stack([self.chars[w] for w in window])
        column = diagonal[:, None] + np.arange(size + width)
        inside = (column >= 0) & (column < len(text))
        there = np.where(inside, text[np.clip(column, 0, len(text) - 1)].astype(np.int64), -1)
        edit, k = 1 << 12, np.arange(width)
        # Edits in the high bits, the column where the path began in the low ones.
        cost = np.broadcast_to(k, (len(window), width)).astype(np.int64)
        for i in range(size):
            step = cost + edit * (there[:, i:i + width] != pattern[:, i, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + edit)
            cost = np.minimum.accumulate(step - k * edit, axis=1) + k * edit
        best = cost.argmin(axis=1)
        value = cost[np.arange(len(window)), best]
        edits, start = value >> 12, diagonal + (value & (edit - 1))
        return [
            (int(w), max(0, int(s)), min(len(text), int(d) + size + int(b)), int(e))
            for w, s, d, b, e in zip(window, start, diagonal, best, edits) if e <= self.budget[w]
        ]

    def leaks(self, text: str | None) -> list[tuple]:
        """``item, start, stop, edits, windows`` of each passage found, places in code points."""
        chars, place = characters(text or "")
        window, diagonal = self.regions(chars)
        if not len(window):
            return []
        found: dict[object, list] = {}
        for w, start, stop, edits in self.aligned(chars, window, diagonal):
            old = found.setdefault(self.item[w], [start, stop, edits, set()])
            old[:3] = [min(old[0], start), max(old[1], stop), min(old[2], edits)]
            old[3].add(w)
        return [
            (i, int(place[a]), int(place[b - 1]) + 1, e, len(ws)) for i, (a, b, e, ws) in
            sorted(found.items(), key=lambda x: (x[1][:2], str(x[0])))
        ]


def _search(shared, shape: str):
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shared.value.leaks(t) for t in part], dtype=object)

    return F.pandas_udf(leaks, shape)


def find_leaks(
    docs: DataFrame, text: str, benchmark: DataFrame, item: str, passage: str, width: int = 100, rate: float = 0.1,
    out: str = "leaks",
) -> DataFrame:
    """``docs`` with an array ``out`` of ``item, start, stop, edits, windows`` per passage found.

    A passage is found where one of its windows (``width`` characters, half overlapping; the
    whole passage if shorter) stands with at most ``rate`` times its length in edits; case,
    and the kind and number of blanks, don't count. ``start`` and ``stop`` span its windows
    found, ``edits`` is the least of them. Null, empty and very short passages (under 8
    characters) find nothing, null and empty texts hold nothing; very long texts are searched
    whole; repeated passages count once per item, repeated rows repeat their result; empty
    tables give empty results; other columns pass through, one named ``out`` is replaced.

    Passages are broadcast in blocks of bounded size, as many passes as there are blocks;
    documents are searched where they are read and never shuffled.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item].dataType.simpleString()
    passages = benchmark.select(F.col(item).alias("item"), F.col(passage).alias("passage")).filter("passage is not null")
    total = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    shape = f"array<struct<item:{kind},start:int,stop:int,edits:int,windows:int>>"
    found = []
    for k in range(blocks):
        own = passages.filter(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Windows.of([(r.item, r.passage) for r in own], width, rate))
        found.append(_search(shared, shape)(F.col(text)))
    return docs.withColumn(out, F.concat(*found))
