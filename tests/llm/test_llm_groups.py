"""Operators across rows against brute force, and their defined results on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import metric_join, mixing, odd_sketches, suffix_runs
from panelwright.llm.common import components, word_count

FOLDER = "/root/testdata/sf0.001"


def reach(ids, links):
    """Smallest id reachable, ids given by position."""
    top = list(range(len(ids)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[root(a)] = root(b)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[root(i)] = min(x, low.get(root(i), x))
    return [low.get(root(i)) for i in range(len(ids))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 299, 299: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"{g}w{rng.randrange(500)}" for _ in range(120)]
        for i in range(12):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append((100 * g + i, " ".join(own)))
    rows += [(900, "A b"), (901, "a  B"), (902, "a b c"), (903, None), (904, ""), (905, " \n"), (900, "A b"), (None, "a b"), (None, None)]
    return rows + [(950, "long " * 60_000), (951, "long " * 60_001)]


def sets_of(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").encode().split() for w in [w.decode()]]
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else ({tuple(words)} if words else set())


@pytest.mark.parametrize(("block", "shingles"), [(1024, 1 << 19), (3, 1 << 19), (1024, 300)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(odd_sketches, "BLOCK", block)
    monkeypatch.setattr(odd_sketches, "BLOCK_SHINGLES", shingles)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = odd_sketches.near_duplicates(docs, "doc_id", "text").collect()
    sets = [sets_of(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = reach([r[0] for r in rows], links)
    wanted = sorted(((str(i), len(s), str(c), i == c) for (i, _), s, c in zip(rows, sets, want)))
    assert sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in got) == wanted
    assert odd_sketches.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


def test_cross_pairs_are_tried_though_the_forest_holds_none(spark, monkeypatch):
    def one_bucket(shingles):
        return np.zeros(odd_sketches.BANDS, np.int64)

    def pivot_first(different, n, m, used, used2, percent, margin):
        return np.where(n != m, 0.9, 0.86) + 0 * different, different >= 0

    monkeypatch.setattr(odd_sketches, "band_keys", one_bucket)
    monkeypatch.setattr(odd_sketches, "may_link", pivot_first)
    both, node = [f"c{i}" for i in range(46)], lambda text: xxhash.xxh3_128_digest(odd_sketches.Shingler(1)(text).tobytes())
    a, b = (" ".join(both + [f"{x}{i}" for i in range(4)]) for x in "ab")
    pivots = (" ".join(both[:40] + [f"{k}p{i}" for i in range(12)]) for k in range(1000))
    p = next(t for t in pivots if node(t) < min(node(a), node(b)))
    docs = spark.createDataFrame([(1, a), (2, b), (3, p)], "doc_id long, text string")
    got = {r.id: r.component_id for r in odd_sketches.near_duplicates(docs, "doc_id", "text", width=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def short_near_copies(n):
    rng = random.Random(9)
    words = [f"w{rng.randrange(2000)}" for _ in range(60)]
    rows = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.choice([1, 2, 2])):
            own[rng.randrange(60)] = f"x{rng.randrange(99999)}"
        rows.append((i, " ".join(own)))
    return rows


def test_rows_between_steps_grow_with_a_group_not_its_square(spark, monkeypatch):
    put, land = {}, odd_sketches.landed

    def counted(df, name):
        out = land(df, name)
        put.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(odd_sketches, "landed", counted)
    for n in (300, 1200):
        rows = short_near_copies(n)
        got = {r.id: r.component_id for r in odd_sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        sets = [sets_of(t) for _, t in rows]
        links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert [got[i] for i in range(n)] == reach(list(range(n)), links)
    assert put["joins"][1] < 1200
    assert all(b <= 6 * a + 100 for a, b in put.values())


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for size in (60, 400, 3000):
        for share in (0.8, 0.9, 0.98):
            both = rng.integers(0, 2**63, size, dtype=np.uint64)
            extra = int(size * (1 - share) / share / 2)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            (x, used), (y, used2) = odd_sketches.odd_sketch(a), odd_sketches.odd_sketch(b)
            differ = np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()
            got = odd_sketches.similarity(differ, len(a), len(b), used, used2)
            errors.append(abs(got - size / (size + 2 * extra)))
    assert max(errors) < 0.05


@pytest.mark.parametrize(("percent", "common", "a", "b"), [
    (85, 6, 1, 0), (85, 12, 1, 1), (85, 17, 2, 1), (85, 34, 3, 3), (80, 4, 1, 0), (80, 8, 1, 1), (80, 20, 3, 2)])
def test_no_pair_of_small_sets_is_lost(percent, common, a, b):
    rng, pairs, n = np.random.default_rng(2), 8000, common + a
    x = rng.integers(0, 2**63, (pairs, n + b), dtype=np.uint64)
    one = [odd_sketches.odd_sketch(r[:n]) for r in x]
    two = [odd_sketches.odd_sketch(np.delete(r, np.s_[common:n])) for r in x]
    bits, used = (odd_sketches._bits([s for s, _ in own]) for own in (one, two)), [np.array([u for _, u in own]) for own in (one, two)]
    different = np.bitwise_count(np.bitwise_xor(*bits)).sum(axis=1)
    score, may = odd_sketches.may_link(different, np.full(pairs, n), np.full(pairs, common + b), *used, percent, 0.07)
    assert may.all() and (common > 20 or (score < percent / 100 - 0.07).any())
    far = odd_sketches.may_link(np.full(1, 2 * n), *(np.full(1, n),) * 4, percent, 0.07)[1]
    assert not far.any()


def test_targets_reshare_the_excess():
    got = mixing.targets([100, 10, 50], [5, 2, 1], 240, 2)
    assert sum(got) == pytest.approx(240) and got[1] == 20 and all(t <= 2 * s for t, s in zip(got, [100, 10, 50]))
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0, 0], [5, 2], 0, 2) == [0, 0]


def test_splitting_tree_deals_each_draw_once():
    quota = [1000, 7, 0, 333]
    paths = [mixing.split_path(quota, 13, s, 5) for s in range(13)]
    for i, n in enumerate(quota):
        cells = sorted(p[i] for p in paths)
        assert sum(b - a for a, b in cells) == n
        assert sorted(x for a, b in cells for x in range(a, b)) == list(range(n))
    sizes = [sum(b - a for a, b in p) for p in paths]
    assert max(sizes) - min(sizes) <= 4


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text")
    odd = [(-1, None, None), (-2, "", "a b"), (-3, None, "c d e"), (-3, None, "c d e"), (None, "src1", "x " * 40_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("_size", F.lit(5))
    size = word_count(F.col("text"))
    first = mixing.draw(docs, "source", size, ["doc_id", "text"]).collect()
    again = mixing.draw(docs.repartition(3), "source", size, ["doc_id", "text"]).collect()
    line = lambda r: (str(r.doc_id), r._size, sorted(r._shards))
    assert sorted(map(line, first)) == sorted(map(line, again)) and len(first) == docs.count()
    taken, target, largest = Counter(), {}, Counter()
    for r in first:
        assert len(r._shards) <= 2
        taken[r.source] += r._size * len(r._shards)
        target[r.source] = r._target
        largest[r.source] = max(largest[r.source], 2 * r._size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r._size for r in first))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    copies = mixing.mix(docs, "source", size, ["doc_id", "text"])
    assert copies.count() == sum(len(r._shards) for r in first)
    assert copies.columns == ["doc_id", "source", "text", "_size", "_shard"]
    assert mixing.draw(docs.limit(0), "source", size, ["doc_id"]).count() == 0


@pytest.mark.parametrize("cell,block", [(1024, 2048), (16, 7)])
def test_range_join_against_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rng.standard_normal(8) * rng.choice([0.02, 0.1, 0.4])
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)] + [(5, rows[5][1], 1), (None, rows[0][1], 0)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [None] + [1.0] * 7, 0), (404, [float("nan")] * 8, 0),
             (405, [float("inf")] * 8, 1), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [x * 1e200 for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, v array<double>, label int, n_links int")
    got = metric_join.range_join(frame, "vec_id", "v", "label").collect()
    good = [r[2] is not None and bool(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    units = [metric_join.unit([r[1]])[0] if g else None for r, g in zip(rows, good)]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98]
    number = Counter(x for pair in links for x in pair)
    want = reach([r[0] for r in rows], links)
    wanted = sorted((str(r[0]), number[i], str(c), r[0] == c) for i, (r, c) in enumerate(zip(rows, want)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == wanted
    assert metric_join.range_join(frame.limit(0), "vec_id", "v", "label").count() == 0


def test_minimizers_are_each_windows_own():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 100, 700), np.tile([97, 98], 300), rng.integers(97, 122, 500)]).astype(np.uint8)
    _, place, first, last = suffix_runs.anchors(data, 200)
    hashes = suffix_runs.gram_hashes(data, suffix_runs.GRAM) & ~np.uint64((1 << 24) - 1)
    served = {s: p for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
    assert sorted(served) == list(range(len(data) - 199))
    assert all(p == s + int(hashes[s:s + 169].argmin()) for s, p in served.items())


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))).encode() for _ in range(500)]
    for n in (1, 2, 5, 8):
        runs = [sorted(words[i::n]) for i in range(n)]
        order, merged, prefix = suffix_runs.merge([suffix_runs.front_code(r) for r in runs])
        assert merged == sorted(words) and [runs[r][i] for r, i in order] == merged
        assert prefix.tolist() == [0] + [suffix_runs.common(a, b, 0) for a, b in zip(merged, merged[1:])]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_runs, "HOT", hot)
    monkeypatch.setattr(suffix_runs, "PART", 5000)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, texts = [make(230), make(199), make(900)], []
    for i in range(30):
        texts.append(make(rng.randrange(400)) + "".join(rng.choice(shared)[rng.randrange(20):] for _ in range(i % 4)) + make(rng.randrange(300)))
    texts += [None, "", "ab " * 4000, texts[3], texts[3], shared[0][:200], make(60_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in suffix_runs.without_repeats(docs, "text").collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + 200] for b in data for s in range(len(b) - 199))
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s:s + 200]] > 1:
                gone[s:s + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert hashlib.sha256(got[i].kept).digest() == hashlib.sha256(kept).digest()
        edge = np.diff(np.pad(gone, 1).astype(int))
        assert [tuple(s) for s in got[i].spans] == list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        assert got[i].n_bytes == len(b)
    assert suffix_runs.without_repeats(docs.limit(0), "text").count() == 0
