"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the corpus's frequent pre-tokens and their lengths in tokens,
broadcast once. Tier two encodes a miss and keeps its length in the worker's own cache. No
pre-token crosses the network: the table comes from bounded summaries, one per task, merged in
a tree.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which this module's and the library's Unicode tables agree; a text with any
#: other character is encoded whole. Tests compare every one of them.
AGREED = (
    "\x00-՗א-תؠ-يऀ-ॿก-ฺḀ-῿‐- ₠-₿℀-⅏"
    "←-⏿─-➿　-〩ぁ-ゖ゠-ヿ一-鿯가-힣！-ﾾ"
    "\U0001f300-\U0001f64f"
)


class Encoder:
    """Counts tokens of texts as the ``tokenizers`` library does for a word-end BPE file."""

    def __init__(self, spec: str, table: dict[str, int] | None = None, cache: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        parts = json.loads(spec)
        steps = [n["type"] for n in parts["normalizer"]["normalizers"]]
        split, level = parts["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel":
            raise ValueError("a lower-casing BPE with word ends is needed")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        special = "|".join(regex.escape(t["content"]) for t in parts["added_tokens"])
        self.odd = regex.compile(f"[^{AGREED}]" + (f"|{special}" if special else "")).search
        self.table = table or {}
        self.cache: dict[str, int] = {}
        self.cache_size = cache

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split(text.lower())

    def length(self, token: str) -> int:
        """Tokens of one pre-token, from the worker's cache or the model."""
        n = self.cache.get(token)
        if n is None:
            n = len(self.tokenizer.model.tokenize(self.bytes_of(token)[0][0]))
            if len(token) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[token] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        get, length, total = self.table.get, self.length, 0
        for token in self.pre_tokens(text):
            total += get(token) or length(token)
        return total


SUMMARY = "tokens array<string>, counts array<bigint>"


def _summary(counts: Counter, width: int) -> pa.RecordBatch:
    top = counts.most_common(width)
    return pa.RecordBatch.from_arrays(
        [pa.array([[t for t, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
        names=["tokens", "counts"],
    )


def frequent_pre_tokens(docs: DataFrame, text: str, spec: str, width: int = 32_768) -> list[str]:
    """The about ``width`` most frequent pre-tokens of all texts.

    Each task keeps at most ``8 * width`` counters while it reads and hands on ``width``;
    summaries merge 16 to 1 until one is left, so the driver gets one row of bounded size.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = Encoder(spec), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value and not encoder.odd(value):
                    counts.update(t for t in encoder.pre_tokens(value) if len(t) <= 64)
                if len(counts) > 8 * width:
                    counts = Counter(dict(counts.most_common(width)))
        yield _summary(counts, width)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for tokens, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t, n in zip(tokens, numbers):
                    counts[t] += n
        yield _summary(counts, width)

    source = docs.select(F.col(text))
    parts = source.rdd.getNumPartitions()
    summary = source.mapInArrow(read, SUMMARY)
    while parts > 1:
        parts = -(-parts // 16)
        summary = summary.repartition(parts).mapInArrow(merge, SUMMARY)
    return [t for row in summary.collect() for t in row.tokens]


def count_tokens(docs: DataFrame, text: str, spec: str, out: str = "n_tokens", width: int = 32_768) -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``out``.

    ``spec`` is the content of a tokenizer file. No begin or end tokens are added; a special
    token's string inside a text counts as the library counts it. Null and empty texts count 0;
    an empty table gives an empty table; other columns pass through untouched, and ``out``
    replaces a column of that name. Very long texts are handled whole. The table's content
    changes the speed only: a pre-token that it lacks is encoded.
    """
    sc = docs.sparkSession.sparkContext
    encoder = Encoder(spec)
    table = sc.broadcast({t: encoder.length(t) for t in frequent_pre_tokens(docs, text, spec, width)})
    shared = sc.broadcast(spec)

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = Encoder(shared.value, table.value)
        for part in parts:
            yield pd.Series([worker.count(t) for t in part], dtype="int64")

    return docs.withColumn(out, tokens(F.col(text)))
