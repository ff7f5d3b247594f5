"""Repeated byte strings by a distributed merge sort of sampled suffixes that reuses prefixes.

Of each window of ``LENGTH`` bytes the q-gram with the least hash is its anchor, so equal windows
have equal anchors at equal places. Suffixes are sorted at anchors only, and only at those whose
q-gram occurs twice: each carries the bytes of all windows that it anchors. Tasks exchange
sorted, front-coded runs; a loser tree merges them, deciding by the known common prefix with the
last winner and looking at bytes beyond it only on a tie. In the merged order the windows with i
bytes left of the anchor form groups of common prefix ``LENGTH - i``; those that also agree on
the i bytes to the left are the repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from panelwright.llm.common import landed, mix64
from panelwright.llm.odd_sketches import text_keys

GRAM = 32
#: Bytes that are searched for anchors at a time, with an overlap, however long a text is.
PART = 4 << 20
#: Anchors at a q-gram that occurs more often are dealt by the bytes beside it as well.
HOT = 20_000
#: Suffixes that one merge takes, and bytes of suffixes that a task gathers for one run.
MERGE, RUN_BYTES = 30_000, 24 << 20

_rng = np.random.default_rng(10)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=total[1:])
    return mix64((total[size:] - total[:-size]) * powers(INVERSE, n))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, place, first, last`` of each anchor and the starts of the windows that it serves."""
    found = []
    step = PART
    for begin in range(0, max(0, len(data) - length + 1), step):
        part = data[begin:begin + step + length - 1]
        hashes = gram_hashes(part, GRAM)
        width = length - GRAM + 1
        # Hash above, place below: the leftmost of equal hashes wins.
        key = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        blocks = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
        blocks[:len(key)] = key
        blocks = blocks.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        least = np.minimum(after[:n], before[width - 1:width - 1 + n])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        at = place[first]
        found.append((hashes[at], at + begin, first + begin, last + begin))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix with the one before, and the rest, of each of the sorted suffixes."""
    prefix, rests, last = [], [], b""
    for s in suffixes:
        n = common(s, last, 0)
        prefix.append(n)
        rests.append(s[n:])
        last = s
    return np.array(prefix, np.int32), rests


def merge(runs: list[tuple[np.ndarray, list[bytes]]]) -> tuple[list[tuple[int, int]], list[bytes], np.ndarray]:
    """Front-coded runs merged by a loser tree: ``(run, position)``, suffix, prefix with the last.

    A stream keeps the length of the prefix that it shares with the last suffix put out. Of two
    streams the one that shares more comes first, and the loser's length stays right; only
    streams that share equally are compared, from there on.
    """
    n = len(runs)
    at, now, shared = [0] * n, [b""] * n, [0] * n

    def advance(s: int) -> None:
        prefix, rests = runs[s]
        if at[s] < len(rests):
            # Front coding gives the prefix with the stream's own last suffix, which was just put out.
            shared[s] = int(prefix[at[s]])
            now[s] = now[s][:shared[s]] + rests[at[s]]
            at[s] += 1
        else:
            now[s], shared[s] = None, -1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if now[a] is None or now[b] is None:
            return (b, a) if now[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        k = common(now[a], now[b], shared[a])
        if now[a][k:k + 1] <= now[b][k:k + 1]:
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    width = 1
    while width < n:
        width *= 2
    at += [0] * (width - n)
    now += [None] * (width - n)
    shared += [-1] * (width - n)
    for s in range(n):
        advance(s)
    tree, winners = [0] * width, [0] * (2 * width)
    winners[width:] = range(width)
    for node in range(width - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if width > 1 else 0
    order, out, prefix = [], [], []
    while now[top] is not None:
        order.append((top, at[top] - 1))
        out.append(now[top])
        prefix.append(shared[top])
        advance(top)
        node = (top + width) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2
    return order, out, np.array(prefix, np.int32)


def repeated(prefix: np.ndarray, lefts: list[bytes], low: np.ndarray, length: int) -> np.ndarray:
    """For each merged suffix and each i, whether its window with i bytes to the left occurs twice.

    ``lefts`` end at the anchor; a suffix serves the i from ``low`` to the size of its left part.
    """
    n, most = len(lefts), length - GRAM
    high = np.array([len(x) for x in lefts])
    flat = np.frombuffer(b"".join(lefts), np.uint8)
    ends = np.cumsum(high)
    hashed, out = np.zeros(n, np.uint64), np.zeros((n, most + 1), bool)
    for i in range(most + 1):
        if i:
            reach = high >= i
            hashed[reach] = mix64(hashed[reach] * np.uint64(BASE) + BYTE[flat[ends[reach] - i]])
        own = np.flatnonzero((low <= i) & (i <= high))
        if len(own) < 2:
            continue
        group = np.cumsum(prefix < length - i)[own].astype(np.uint64)
        key = mix64(group) + hashed[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[own[order[twice]], i] = True
    return out


#: ``at`` packs an anchor's place, how far before it its first window starts, and how many follow.
ANCHOR = "h long, t1 long, t2 long, at long"
RUN = ("part int, prefix binary, sizes binary, rests binary, low binary, left_sizes binary, lefts binary, number binary, "
       "places binary, done binary")


def entries(h: int, hot: bool, data: bytes, place: int, low: int, high: int, length: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """``part, low, high``: where an anchor's windows, with ``low`` to ``high`` bytes left of it, are merged.

    Equal windows have equal bytes beside their equal anchors, so those of a frequent q-gram can
    be dealt by these: by the bytes behind the q-gram if enough of the window lies there, else by
    those before it.
    """
    if not hot:
        yield h % parts, low, high
        return
    half = (length - GRAM) // 2
    if low <= half:
        behind = data[place + GRAM:place + length - half]
        yield xxhash.xxh3_64_intdigest(behind, h & 0xFFFFFFFF) % parts, low, min(high, half)
    if high > half:
        before = data[place - half - 1:place]
        yield xxhash.xxh3_64_intdigest(before, ~h & 0xFFFFFFFF) % parts, max(low, half + 1), high


def _write_run(part: int, suffixes: dict[tuple[bytes, bytes, int], list[tuple[int, int, int]]], length: int) -> tuple:
    """A sorted run. Of places with the same bytes two suffice to find others; the rest are done:
    their windows occur twice already, and only their spans go on."""
    keys = sorted(suffixes)
    done = [(t1, t2, p - len(k[1]), p - k[2] + length) for k in keys for t1, t2, p in suffixes[k][2:]]
    suffixes = {k: suffixes[k][:2] for k in keys}
    prefix, rests = front_code([k[0] for k in keys])
    ints = lambda values: np.array(values, np.int32).tobytes()
    places = [p for k in keys for p in suffixes[k]]
    return (part, prefix.tobytes(), ints([len(r) for r in rests]), b"".join(rests), ints([k[2] for k in keys]),
            ints([len(k[1]) for k in keys]), b"".join(k[1] for k in keys), ints([len(suffixes[k]) for k in keys]),
            np.array(places, np.int64).tobytes(), np.array(done, np.int64).tobytes())


def _cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def repeated_spans(docs: DataFrame, text: str, length: int = 200) -> DataFrame:
    """``t1, t2, spans``: the bytes of each text that a repeated string of ``length`` bytes covers.

    Texts are found by their two digests (see ``text_keys``); a text without repeats has no row.
    ``spans`` are ``start, stop`` in UTF-8 bytes, in order, apart. A string counts as repeated
    if it starts anywhere else too, in another row, an equal row or the same text; overlapping
    places count. Null and short texts have no strings; very long texts are searched in parts
    that overlap; an empty table gives an empty result.

    What crosses the network is a line of numbers per anchor (about one in 85 bytes) and the
    bytes around anchors whose q-gram occurs twice, front-coded. No merge takes an unbounded
    group: a frequent q-gram's anchors are dealt by the bytes beside it, and a run holds a
    string and its surroundings twice at most, however often they occur.
    """
    keyed = text_keys(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "text").filter(
        F.octet_length("text") >= length)
    keyed = keyed.select("t1", "t2", "text")

    def list_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for t1, t2, value in zip(*(c.to_pylist() for c in batch.columns)):
                h, place, first, last = anchors(np.frombuffer(value.encode(), np.uint8), length)
                at = place << 32 | place - first << 16 | last - first
                lines.append((h.view(np.int64), np.full(len(h), t1), np.full(len(h), t2), at))
            if lines:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*lines)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "t1", "t2", "at"])

    listed = landed(keyed.mapInArrow(list_anchors, ANCHOR), "anchors")
    counts = landed(listed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // MERGE))
    chosen = (
        listed.join(counts.select("h", (F.col("n") > HOT).alias("hot")), "h").groupBy("t1", "t2")
        .agg(F.collect_set(F.struct("at", "h", "hot")).alias("anchors"))
    )
    packed = keyed.withColumn("text", _pack("text"))

    def write_runs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [c.split()[0] for c in RUN.split(", ")]
        runs: dict[int, dict] = {}
        held = 0
        for frame in frames:
            for t1, t2, value, own in zip(frame["t1"], frame["t2"], frame["text"], frame["anchors"]):
                data = unpack(value)
                for a in own:
                    place, before, follow = a["at"] >> 32, a["at"] >> 16 & 0xFFFF, a["at"] & 0xFFFF
                    for part, low, high in entries(a["h"], a["hot"], data, place, before - follow, before, length, parts):
                        # The suffix, what its windows hold to its left, and the least that they hold there.
                        key = (data[place:place - low + length], data[place - high:place], low)
                        own_ = runs.setdefault(part, {}).setdefault(key, [])
                        held += len(key[0]) + len(key[1]) if not own_ else 100
                        own_.append((t1, t2, place))
                if held > RUN_BYTES:
                    yield pd.DataFrame([_write_run(p, s, length) for p, s in runs.items()], columns=names)
                    runs, held = {}, 0
        if runs:
            yield pd.DataFrame([_write_run(p, s, length) for p, s in runs.items()], columns=names)

    def merge_runs(frame: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: [np.frombuffer(x, np.int32) for x in frame[c]]
        runs = [(p, _cut(r, s)) for p, s, r in zip(read("prefix"), read("sizes"), frame["rests"])]
        order, _, prefix = merge(runs)
        lefts, low, number, places = [], [], [], []
        cut = [_cut(x, s) for x, s in zip(frame["lefts"], read("left_sizes"))]
        lows, numbers = read("low"), read("number")
        at = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in frame["places"]]
        begin = [np.cumsum(x) - x for x in numbers]
        for run, i in order:
            lefts.append(cut[run][i])
            low.append(lows[run][i])
            number.append(numbers[run][i])
            places.append(at[run][begin[run][i]:begin[run][i] + numbers[run][i]])
        low, number = np.array(low), np.array(number)
        found = repeated(prefix, lefts, low, length)
        i = np.arange(found.shape[1])
        found |= (number > 1)[:, None] & (low[:, None] <= i) & (i <= np.array([len(x) for x in lefts])[:, None])
        # Stretches of i: windows that start side by side.
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        stop = np.nonzero(edge == -1)[1] - 1
        spread = np.repeat(np.arange(len(row)), number[row])
        spots = np.concatenate([places[r] for r in row]) if len(row) else np.empty((0, 3), np.int64)
        done = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in frame["done"]])
        return pd.DataFrame({
            "t1": np.concatenate([spots[:, 0], done[:, 0]]), "t2": np.concatenate([spots[:, 1], done[:, 1]]),
            "start": np.concatenate([spots[:, 2] - stop[spread], done[:, 2]]),
            "stop": np.concatenate([spots[:, 2] - start[spread] + length, done[:, 3]])})

    runs = packed.join(chosen, ["t1", "t2"]).mapInPandas(write_runs, RUN)
    spans = runs.groupBy("part").applyInPandas(merge_runs, "t1 long, t2 long, start long, stop long")

    @F.pandas_udf("array<struct<start:long,stop:long>>")
    def united(parts: pd.Series) -> pd.Series:
        out = []
        for part in parts:
            done: list[list[int]] = []
            for start, stop in sorted((p["start"], p["stop"]) for p in part):
                if done and start <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], stop)
                else:
                    done.append([start, stop])
            out.append([tuple(d) for d in done])
        return pd.Series(out, dtype=object)

    together = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("all"))
    return landed(together.select("t1", "t2", united("all").alias("spans")), "spans")


@F.pandas_udf(BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    """Texts in a compact form for the way to another task."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([pack(t.encode()) for t in texts], dtype=object)


@F.pandas_udf(BinaryType())
def _kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for text, own in zip(texts, spans):
        data, at, parts = unpack(text) if text else b"", 0, []
        for s in own if own is not None else ():
            parts.append(data[at:s["start"]])
            at = s["stop"]
        out.append(b"".join([*parts, data[at:]]))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, text: str, length: int = 200) -> DataFrame:
    """``docs`` but ``text``, with ``n_bytes``, ``spans`` (removed) and ``kept`` (the other bytes).

    Defined results as for :func:`repeated_spans`; null texts count as empty, columns named as
    the three results are replaced, all others pass through. ``kept`` is binary, since a cut may
    part the bytes of a character.
    """
    spans = repeated_spans(docs, text, length)
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "spans", "kept")]
    rows = docs.select(F.struct(*passed).alias("row") if passed else F.struct(F.lit(1)).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = text_keys(rows, "text").select("row", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"),
                                         _pack("text").alias("packed"))
    out = rows.join(spans, ["t1", "t2"], "left").withColumn("kept", _kept("packed", "spans"))
    return out.select("row.*", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"), "kept")
