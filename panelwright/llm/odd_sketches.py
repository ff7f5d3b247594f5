"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Bands of MinHash values propose pairs. Odd sketches judge them: each shingle set's MinHash
samples (one permutation, the least value of each of 1,024 bins) are folded into a bitmap by
parity, so the bitmaps of two sets differ, by XOR, in about as many bits as their samples do;
that count estimates a high similarity with a deviation near 0.012. What lies clearly below the
bound is let go, all else is confirmed on the full sets. Of small sets, where one shingle more can
move the estimate far, only what the count rules out for certain is let go.

No group is expanded into its pairs. A band's bucket first proposes its members' pairs with one
of them. Buckets that still hold several components go, with their members' full sets, to tasks
that judge every cross pair by sketch and confirm what is left on the spot. Only links that
join components leave such a task, fewer than it has members, and no link between components is
missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, landed, mix64

BANDS, ROWS = 25, 5
BINS, BITS = 1024, 2048
#: Pairs with a set of fewer shingles are let go by a bound that holds for certain.
SMALL = 512
#: Members of a bucket that are compared in one task with as many others, and shingles of these.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Text keys up to this many bytes are broadcast, more are shuffled; bytes of one key.
BROADCAST_BYTES, KEY_BYTES = 16 << 20, 40

_rng = np.random.default_rng(4)
FACTORS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
WORDS = _rng.integers(0, 2**63, 8, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are hashed once each."""

    def __init__(self, width: int = 3, cache: int = 300_000):
        self.width, self.size = width, cache
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # blanks are 0x20 and 0x09-0x0D
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.size:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        total = np.zeros(n, np.uint64)
        for i in range(min(self.width, len(h))):
            total = mix64(total + h[i:i + n] * WORDS[i])
        if len(h) < self.width:
            total = mix64(total + np.uint64(len(h)))
        return np.unique(total)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of MinHash values under random linear permutations."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i:i + 256, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key + least[r::ROWS].astype(np.uint64) * WORDS[r])
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the bins' least values, and the number of bins in use."""
    mixed = np.sort(mix64(shingles ^ WORDS[6]))
    bins = mixed >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(2**64 - 1)))
    spots = (mix64(mixed[first] ^ WORDS[7]) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(spots, minlength=BITS) & 1 == 1).tobytes(), len(first)


def similarity(different: np.ndarray, n: np.ndarray, m: np.ndarray, used: np.ndarray, used2: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the number of differing bits and the sets' sizes."""
    odd = -(BITS / 2) * np.log(np.maximum(1e-9, 1 - 2 * different / BITS))
    match = np.maximum(0, (used + used2 - odd) / 2)
    free = 1 - 1 / BINS
    # Bins in use by the union, scaled as the two sets' own bins came out against expectation.
    scale = (used + used2) / (2 - free**n - free**m)
    j = np.minimum(1, match / np.maximum(1, np.maximum(used, used2)))
    for _ in range(6):
        j = np.minimum(1, match / np.maximum(1, scale * (1 - free ** ((n + m) / (1 + j)))))
    return j


def may_link(
    different: np.ndarray, n: np.ndarray, m: np.ndarray, used: np.ndarray, used2: np.ndarray, percent: int, margin: float
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs, and whether a pair may reach ``percent``.

    A bin whose samples differ holds a shingle of one set alone and changes two bits at most, so
    half the differing bits are no more than the shingles that are not common. Pairs that link
    have at most ``(100 - percent) / (100 + percent)`` of both sets' sizes of these. That rule
    loses no pair; with many shingles a bin it rules out little, so larger sets go by estimate.
    """
    score = similarity(different, n, m, used, used2)
    certain = different.astype(np.int64) * (100 + percent) <= 2 * (100 - percent) * (n + m)
    return score, np.where(np.minimum(n, m) < SMALL, certain, score >= percent / 100 - margin)


def _bits(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _block_joins(part: pd.DataFrame, percent: int, margin: float) -> Iterator[tuple]:
    """Links, as pairs of components, that join the components of one block's members.

    A cross pair is judged by sketch in the first band that both sets share and then confirmed on
    the full sets; pairs whose components have been joined already are not.
    """
    bits, n, used = _bits(part["sketch"]), part["n"].to_numpy(), part["used"].to_numpy()
    root, names = pd.factorize(part["component"])
    first = root.copy()
    bands, band, block = np.stack(part["bands"].to_numpy()), part["band"].iat[0], part["i"].to_numpy()
    far = part["p"].iat[0] != part["q"].iat[0]
    codes = held = None
    for x in range(len(part) - 1):
        y = np.flatnonzero(root[x + 1:] != root[x]) + x + 1
        if far:
            y = y[block[y] != block[x]]
        y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
        if len(y) and band:  # a pair belongs to the first band that it shares
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
        if len(y):
            different = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
            y = y[may_link(different, n[x], n[y], used[x], used[y], percent, margin)[1]]
        if not len(y):
            continue
        if codes is None:  # shingles numbered once per block, so that common ones are counted by a lookup
            ends = np.cumsum(n)
            flat = np.unique(np.concatenate([np.frombuffer(v, np.uint64) for v in part["shingles"]]), return_inverse=True)[1]
            codes, held = np.split(flat, ends[:-1]), np.zeros(flat.max() + 1, np.int64)
        held[codes[x]] = 1
        common = np.add.reduceat(held[np.concatenate([codes[k] for k in y])], np.append(0, np.cumsum(n[y])[:-1]))
        held[codes[x]] = 0
        for k in y[100 * common >= percent * (n[x] + n[y] - common)]:
            if root[k] != root[x]:
                yield names[first[x]], names[first[k]]
                root[root == root[k]] = root[x]


def _joins(percent: int, margin: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole blocks of the sorted rows; the last of a batch waits for the next batch."""
        rest = None
        for frame in chain(filter(len, frames), [None]):
            last = frame is None
            frame = rest if last else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if frame is None:
                return
            key = frame[["band", "bucket", "p", "q"]].to_numpy()
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
            ends = [*starts[1:], len(frame)]
            if not last:
                rest = frame.iloc[starts[-1]:]
                starts, ends = starts[:-1], ends[:-1]
            pairs = [x for a, b in zip(starts, ends) for x in _block_joins(frame.iloc[a:b], percent, margin)]
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    return walk


def near_duplicates(
    docs: DataFrame, id_: str, text: str, percent: int = 85, width: int = 3, margin: float = 0.07
) -> DataFrame:
    """One row per row of ``docs``: ``id, t1, t2, n_shingles, component_id, kept, first``.

    ``t1, t2`` are xxhash64 digests of the text (see :func:`text_keys`), which with the id find
    the row again. Sets of distinct ``width``-word shingles (A-Z lowered, words between ASCII
    blanks; all words as one shingle if there are fewer) link if 100 times the intersection is
    at least ``percent`` times the union. ``component_id`` is the smallest id reachable, null
    ids aside; ``kept`` marks the rows that bear it, ``first`` the one row of the component (and
    its repetitions) that comes first by id, null ids last, then ``t1, t2``. Null, empty and blank texts have no
    shingles and link with nothing. Repeated rows, equal sets and texts that a third of all
    rows share are one node; very long texts are taken whole; an empty table stays empty.

    Pairs that link share a band with a chance over 1 - 1e-6 each. Pairs whose estimate lies
    ``margin``, over five deviations, below the bound are not confirmed; with a set of under
    ``SMALL`` shingles, only pairs that cannot link (see :func:`may_link`).
    """
    keyed = text_keys(docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text")

    @F.pandas_udf("n_shingles long, node binary, bands array<long>")
    def outline(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for part in parts:
            lines = []
            for value in part:
                s = shingler(value)
                lines.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s)) if len(s) else (0, None, None))
            yield pd.DataFrame(lines, columns=["n_shingles", "node", "bands"])

    rows = landed(keyed.withColumn("o", outline("text")).select("id", "t1", "t2", "o.*"), "outlines")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    buckets = nodes.select("node", "t", "size", F.posexplode("bands").alias("band", "bucket"))
    pivots = buckets.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.min("node").alias("pivot"))
    buckets = landed(buckets.join(pivots.filter("members > 1"), ["band", "bucket"]), "buckets")

    needed = buckets.groupBy("node").agg(F.first("t").alias("t")).select("node", "t.*")
    needed = landed(needed, "needed")
    texts = keyed.select("t1", "t2", "text").join(
        F.broadcast(needed) if needed.count() * KEY_BYTES <= BROADCAST_BYTES else needed, ["t1", "t2"])

    @F.pandas_udf("n long, used int, sketch binary, shingles binary")
    def full(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for part in parts:
            lines = []
            for value in part:
                s = shingler(value)
                sketch, used = odd_sketch(s)
                lines.append((len(s), used, sketch, s.tobytes()))
            yield pd.DataFrame(lines, columns=["n", "used", "sketch", "shingles"])

    sets = landed(texts.dropDuplicates(["node"]).select("node", full("text").alias("f")).select("node", "f.*"), "sets")
    light = sets.select("node", "n", "used", "sketch")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series, used: pd.Series, used2: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="bool")
        different = np.bitwise_count(_bits(a) ^ _bits(b)).sum(axis=1)
        return pd.Series(may_link(different, n.to_numpy(), m.to_numpy(), used.to_numpy(), used2.to_numpy(), percent, margin)[1])

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype="bool")

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in frame.columns])

    tried = buckets.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = tried.join(side(light, "a"), "a").join(side(light, "b"), "b")
    pairs = pairs.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    pairs = landed(pairs.filter(near("a_sketch", "b_sketch", "a_n", "b_n", "a_used", "b_used")).select("a", "b"), "pairs")
    full_sets = sets.select("node", "shingles")
    pairs = pairs.join(side(full_sets, "a"), "a").join(side(full_sets, "b"), "b")
    groups = components(landed(pairs.filter(linked("a_shingles", "b_shingles")).select("a", "b"), "links"))

    # Buckets that hold several components; of those with the same members, that of the first band.
    named = buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("band", "bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.sum("size").alias("shingles"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("i")).filter("x != y")
    several = several.groupBy("m", "h", "i", "shingles").agg(F.min(F.struct("band", "bucket")).alias("own")).select(
        "own.*", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = named.select("node", "component", "band", "bucket").join(several, ["band", "bucket"])
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A member of block i meets block j in task (min, max): each pair of blocks has one task.
    dealt = dealt.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("band", "bucket", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "node", "component")
    dealt = dealt.join(sets, "node").join(nodes.select("node", "bands"), "node").drop("node")
    dealt = dealt.repartition("band", "bucket", "p", "q").sortWithinPartitions("band", "bucket", "p", "q")
    joins = dealt.mapInPandas(_joins(percent, margin), "a binary, b binary").distinct()
    joined = components(landed(joins, "joins")).select(F.col("node").alias("component"), F.col("component").alias("into"))

    named = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(joined, "component", "left").withColumn("component", F.coalesce("into", "component"))
    named = landed(named.select("id", "t1", "t2", "n_shingles", "component"), "named")
    # Landed, so that the join below has an exchange on either side and Spark can split a large group.
    line = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    lowest = landed(named.filter("component is not null").groupBy("component").agg(F.min(line).alias("lowest")), "lowest")
    out = named.join(lowest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("lowest.id"))
    first = F.col("component").isNull() | line.eqNullSafe(F.col("lowest"))
    return out.select("id", "t1", "t2", "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), first.alias("first"))


def text_keys(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with two 64-bit digests ``t1, t2`` of the text, null as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(value), "t2": F.xxhash64(F.lit(17), value)})
