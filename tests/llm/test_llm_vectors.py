"""Exact search and clustering against brute force in Python integers, and odd rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import integers, pca_clusters, pivot_search


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(size, n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(size) * rng.choice([0.01, 0.2, 1.0])]) for i in range(n)]
    rows += [(1000 + i, rows[4][1]) for i in range(n // 3)]  # one vector that many rows share
    rows += [(5, rows[5][1]), (None, rows[6][1]), (50, rows[50][1]), (50, rows[50][1])]
    rows += [(2000, None), (2050, [None] + [1.0] * (size - 1)), (2100, [float("nan")] * size), (2150, [float("inf")] * size)]
    rows += [(2200, []), (2250, []), (2300, [1.0, 2.0]), (2350, [3.0, 4.0]), (2400, [0.5]), (2450, [0.0] * size)]
    return rows + [(2500, [1e9] * size), (2501, [1e9] * (size - 1) + [1e9 + 4]), (2502, [1e12] * size)]


@pytest.mark.parametrize(("block", "pivots"), [(2048, 32), (16, 5)])
def test_top_products_against_all_pairs(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "PIVOTS", pivots)
    monkeypatch.setattr(pivot_search, "QUERIES", 2048 // block * 3)
    monkeypatch.setattr(pivot_search, "SUMMARIES", 4)
    rows = vectors(8, 240)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, v array<double>, score int, c string")
    got = pivot_search.top_products(frame.repartition(5), "vec_id", "v", F.col("vec_id") % 50 == 0).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if usable(v)]
    want = []
    for a, (q, x) in enumerate(whole):
        if q is not None and q % 50 == 0:
            score = lambda y: min(sum(s * t for s, t in zip(x, y)), 2**63 - 1)
            others = [(-score(y), i is None, i or 0) for b, (i, y) in enumerate(whole) if b != a and len(y) == len(x)]
            want += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(others)[:5], 1)]
    line = lambda r: tuple(map(str, r))
    assert sorted(map(line, got)) == sorted(map(line, want)) and len(want) > 40
    assert pivot_search.top_products(frame.limit(0), "vec_id", "v", F.lit(True)).count() == 0
    assert pivot_search.top_products(frame, "vec_id", "v", F.lit(None).cast("boolean")).count() == 0


def test_search_stops_before_the_end(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.floor(256 * (np.repeat(rng.standard_normal((20, 16)) * 4, 50, axis=0) + rng.standard_normal((1000, 16)) * 0.05))
    pivots = np.vstack([np.zeros(16), v[::50]])
    table = np.sqrt(((v[:, None] - pivots) ** 2).sum(axis=2))
    seen = []
    monkeypatch.setattr(pivot_search, "products", lambda m, q, b: seen.append(len(m)) or integers.products(m, q, b))
    square = (v * v).sum(axis=1)
    for i in range(0, 1000, 111):
        at, scores = pivot_search.search(v[i], square[i], table[i], -np.inf, v, square, table, np.ones(1000, np.int64), 5)
        best = np.sort(v @ v[i])[::-1][:5]
        assert sorted(scores, reverse=True)[:5] == best.tolist() and (scores == v[at] @ v[i]).all()
    assert sum(seen) < 10 * 400


def plain_clusters(whole, k, rounds, start):
    first = sorted(whole, key=lambda r: (start(r[0]) is None, start(r[0]) or "", r[1]))[:k]
    centres = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in whole:
            groups[min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))].append(v)
        for c, own in groups.items():
            centres[c] = [sum(x) // len(own) for x in zip(*own)]
    return centres, [min((far(v, c), i) for i, c in enumerate(centres)) for _, v in whole]


@pytest.mark.parametrize("lead", [3, 8])
def test_clusters_against_plain_integers(spark, lead):
    rows = vectors(8, 150)
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, v array<double>, cluster int, start string, row double")
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    got = pca_clusters.clusters(frame.repartition(4), "v", start, size=8, k=5, lead=lead)
    assert got.columns == ["vec_id", "v", "start", "row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if usable(v) and len(v) == 8]
    centres, near = plain_clusters(whole, 5, 3, lambda i: None if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = 2**63 - 1
    sums = [min(top, sum(min(top, d) for d, c in near if c == i)) for i in range(5)]
    total = min(top, sum(min(top, d) for d, _ in near))
    want = sorted((str(i), c, min(top, d), sums[c], total, names[c]) for (i, _), (d, c) in zip(whole, near))
    keys = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((str(r.vec_id), *[r[k] for k in keys]) for r in got.collect()) == want


def test_clusters_of_few_and_of_no_rows(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "vec_id long, v array<double>")
    got = pca_clusters.clusters(frame, "v", F.col("vec_id"), size=2, k=16, factor=64).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert pca_clusters.clusters(frame.filter("vec_id = 3"), "v", F.col("vec_id"), size=2).count() == 0
    assert pca_clusters.clusters(frame.limit(0), "v", F.col("vec_id"), size=2).count() == 0


def test_rotated_bounds_rule_out_and_never_lose():
    rng = np.random.default_rng(4)
    m = np.floor(64 * (rng.standard_normal((500, 32)) * 3 * 0.6 ** np.arange(32)))
    mean, axes = pca_clusters.rotation(len(m), m.sum(axis=0), m.T @ m, 6)
    centres = [[int(x) for x in row] for row in m[::31]]
    first, rest = pca_clusters.turned(m, mean, axes)
    at, far = pca_clusters.assign(m, first, rest, centres, mean, axes)
    every = ((m[:, None] - np.array(centres)) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (far.astype(float) == every.min(axis=1)).all()
    near, norm = pca_clusters.turned(np.array(centres, float), mean, axes)
    low = ((first[:, None] - near) ** 2).sum(axis=2) + (rest[:, None] - norm) ** 2
    assert (low <= every + 1e-3).all() and (low > every.min(axis=1)[:, None]).mean() > 0.8
