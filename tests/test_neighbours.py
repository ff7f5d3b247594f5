"""Exact neighbour joins and resampling, with many exact copies among the points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import neighbours as N, resample as R


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    n = 240
    x = rng.normal(size=(n, 3)).round(1)
    x[:80] = x[0]
    label = (rng.random(n) < 0.25).astype(int)
    label[:80] = 0
    return pd.DataFrame({"id": np.arange(n), "vec": list(x), "label": label})


def spark_points(spark, points):
    rows = [(int(r.id), [float(v) for v in r.vec], int(r.label)) for r in points.itertuples()]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


@pytest.mark.parametrize("cells, block", [(None, 4096), (9, 4096), (6, 8), (1, 20)])
def test_join_is_exact(spark, points, cells, block, monkeypatch):
    monkeypatch.setattr(N, "QUERY_ROWS", 4 * block)
    distinct = N.distinct_vectors(spark_points(spark, points), "vec", "id")
    got = N.knn_join(distinct, distinct, 4, cells=cells, block_rows=block).toPandas()
    local = distinct.toPandas()
    assert local["copies"].max() >= 80
    x = np.stack(local["vec"].to_numpy())
    ids = local["vid"].to_numpy()
    for i, vid in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((dist, int(o)) for dist, o in zip(d, ids) if o != vid)[:4]
        mine = got[got["qid"] == vid].sort_values("rank")
        assert list(mine["distance"]) == pytest.approx([o[0] for o in order])
        assert list(mine["rank"]) == [1, 2, 3, 4]


def test_queries_of_their_own(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(150, 2)), rng.normal(size=(40, 2)) * 3
    frame = lambda m, at: spark.createDataFrame([(at + i, [float(v) for v in r]) for i, r in enumerate(m)], "vid long, vec array<double>")
    got = N.knn_join(frame(q, 1000), frame(x, 0), 3, cells=12, block_rows=16).toPandas()
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        mine = got[got["qid"] == 1000 + i].sort_values("rank")
        assert mine["pid"].tolist() == np.argsort(d, kind="stable")[:3].tolist()
    few = N.knn_join(frame(q, 1000), frame(x[:2], 0), 3).toPandas()
    assert len(few) == 80 and N.knn_join(frame(q, 1000), frame(x, 0).limit(0), 3).count() == 0


def test_a_query_visits_no_more_blocks_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 32)
    copies = {}
    for n in (1500, 6000):
        x = np.random.default_rng(1).random((n, 2))
        frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, vec array<double>")
        tree, _, seeds = N.seeded(frame, frame, 3, None, 2048)
        assert len(tree.pivots) == n // 32
        copies[n] = N.routed(tree, seeds).count() / n
    assert copies[6000] < 1.2 * copies[1500] and copies[1500] < 8


def neighbours_of(points, i, k):
    x = np.stack(points["vec"].to_numpy())
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[i] = np.inf
    cut = np.sort(d)[k - 1]
    return np.flatnonzero(d <= cut + 1e-9), np.flatnonzero(d < cut - 1e-9)


def test_interpolation_balances_and_stays_between_neighbours(spark, points):
    df = spark_points(spark, points)
    out = R.interpolate_minority(df, "vec", "label", "id", minority=1).toPandas()
    counts = out["label"].value_counts()
    assert counts[0] == counts[1]
    again = R.interpolate_minority(df.repartition(7), "vec", "label", "id", minority=1).toPandas()
    key = lambda f: sorted(map(tuple, f["vec"].map(lambda v: tuple(np.round(v, 9)))))
    assert key(out) == key(again)
    minority = points[points["label"] == 1].reset_index(drop=True)
    x = np.stack(minority["vec"].to_numpy())
    segments = []
    for i in range(len(minority)):
        wide, _ = neighbours_of(minority, i, 5)
        segments += [(x[i], x[j]) for j in wide]
    for v in out[out["synthetic"]]["vec"].map(np.array):
        assert min(_off_segment(v, a, b) for a, b in segments) < 1e-9


def _off_segment(v, a, b):
    span = ((b - a) ** 2).sum()
    t = 0.0 if span == 0 else np.clip(((v - a) @ (b - a)) / span, 0, 1)
    return float(np.abs(v - (a + t * (b - a))).max())


def test_editing_drops_disagreeing_rows(spark, points):
    kept = {r["id"] for r in R.edited_neighbours(spark_points(spark, points), "vec", "label", "id").collect()}
    label = points["label"].to_numpy()
    for i in range(len(points)):
        wide, sure = neighbours_of(points, i, 3)
        if i in kept:
            assert (label[sure] == label[i]).all()
        else:
            assert (label[wide] != label[i]).any()


def test_lonely_minority_is_left_alone(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, [2.0], 0)], "id long, vec array<double>, label int")
    assert R.interpolate_minority(df, "vec", "label", "id", minority=1).count() == 3


def test_noise_copies(spark):
    df = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("v"))
    out = R.noise_copies(df, "v", "id", copies=5, sd=0.05, static_from=2)
    flat = np.stack(out.toPandas()["v"].to_numpy())
    assert flat.shape == (2500, 3)
    assert flat.mean(axis=0) == pytest.approx([1, 2, 3], abs=0.01)
    assert flat.std(axis=0) == pytest.approx([0.05, 0.05, 0.025], rel=0.1)
    assert abs(np.corrcoef(flat[:, 0], flat[:, 1])[0, 1]) < 0.1


def test_mixup(spark):
    df = spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("v"))
    out = R.mixup_pairs(df, "v", "id").toPandas()
    assert len(out) == 600 and (out["id"] != out["partner"]).all()
    want = out["weight"] * out["id"] + (1 - out["weight"]) * out["partner"]
    assert out["vec"].map(lambda v: v[0]).to_numpy() == pytest.approx(want.to_numpy())
    assert ((out["weight"] < 0.1) | (out["weight"] > 0.9)).mean() > 0.4


def test_a_query_is_sent_once_per_slab_where_no_bound_rules_any_cell_out(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(1200, 48))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, vec array<double>")
    monkeypatch.setattr(N, "CELL_ROWS", 10)
    monkeypatch.setattr(N, "SLABS", 4)
    tree, _, seeds = N.seeded(frame, frame, 3, None, 64)
    assert len(tree.pivots) == 120 and N.routed(tree, seeds).count() <= 1200 * 20
    got = N.knn_join(frame, frame, 3, block_rows=64).toPandas().sort_values(["qid", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got["pid"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_tasks_of_a_join_go_by_rows_and_not_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(N, "FIT_ROWS", 100)
    monkeypatch.setattr(N, "QUERY_ROWS", 50)
    x = np.random.default_rng(6).normal(size=(1000, 6))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, vec array<double>").coalesce(1)
    tree, _, seeds = N.seeded(frame, frame, 3, 40, 64)
    assert seeds.rdd.getNumPartitions() == 10
    sent = N.routed(tree, seeds).groupBy("slab").agg(F.count("vid").alias("n"), F.max("part").alias("last")).collect()
    assert {r["slab"]: -(-r["n"] // 50) for r in sent} == {s: n for s, n in enumerate(tree.parts) if n}
    assert max(r["last"] for r in sent) > 0
    got = N.knn_join(frame, frame, 3, cells=40, block_rows=64).toPandas().sort_values(["qid", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got["pid"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_editing_reads_interpolated_rows_that_were_written(spark, points, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "edited_neighbours", lambda df, *_: seen.append(df) or df)
    grown = R.balance(spark_points(spark, points), "vec", "label", "id", minority=1)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan and "Generate" not in plan
    assert {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()} == dict.fromkeys((0, 1), int((points["label"] == 0).sum()))


def nearest_by_hand(rows, k):
    """(qid, pid, distance, rank) of a join of all rows whose identities differ; unknown distances come last."""
    pools = {}
    for q, a in rows:
        for p, b in rows:
            if q is not None and p is not None and p != q:
                d = None if a is None or b is None else round(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, 6)
                pools.setdefault(q, []).append((d is None, d, p))
    return sorted((q, p, d, i + 1) for q, pool in pools.items() for i, (_, d, p) in enumerate(sorted(pool, key=lambda t: (t[0], t[1] or 0.0, t[2]))[:k]))


def test_every_row_has_its_neighbours_copies_among_them(spark):
    rng = np.random.default_rng(3)
    spots = [[float(v) for v in r] for r in rng.integers(0, 3, size=(9, 3))]
    copies = [(i, spots[rng.integers(9)]) for i in range(60)] + [(100 + i, [float(i), 9.0, 9.0]) for i in range(20)]
    several = [(int(rng.integers(0, 25)), [float(rng.integers(0, 6)), 0.0]) for _ in range(60)] + [(7, [50.0, 0.0])] * 2
    unknown = [(i if i % 6 else None, None if i % 4 == 0 else [float(i % 5)]) for i in range(30)]
    for rows in (copies, several, unknown, [(1, [0.0]), (2, None), (3, None), (4, [0.5])], [(1, None), (2, None)]):
        frame = spark.createDataFrame(rows, "id long, vec array<double>")
        got = N.nearest_rows(frame, "vec", "id", 3)
        assert got.columns == ["qid", "pid", "distance", "rank"]
        assert sorted((r["qid"], r["pid"], r["distance"] if r["distance"] is None else round(r["distance"], 6), r["rank"]) for r in got.collect()) == nearest_by_hand(rows, 3)


def test_nearest_neighbours_leaves_no_copy_out(spark, tmp_path):
    from panelwright.catalog.modelling import nearest_neighbours

    rows = [(i, [0.0, float(max(0, i - 5))], 0) for i in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["qid"], r["rank"]): (r["pid"], r["distance"]) for r in nearest_neighbours(spark, str(tmp_path)).collect()}
    assert len(got) == 30
    assert [got[5, i] for i in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert [got[6, i] for i in (1, 2, 3)] == [(0, 1.0), (1, 1.0), (2, 1.0)]
