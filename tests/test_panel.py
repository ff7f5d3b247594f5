"""Panel reshaping and window invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import panel as P, windows as W


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(40):
        last = int(rng.integers(0, 13))
        for s in range(last + 1):
            if rng.random() < 0.7:
                rows.append((e, s, float(rng.integers(0, 20)), None if rng.random() < 0.3 else float(rng.normal())))
    rows.append((99, 4, 1.0, None))
    return spark.createDataFrame(rows, "entity int, step int, a double, b double")


def test_densify_has_every_step(spark, panel):
    dense = P.densify(panel, "entity", "step", ["a", "b"])
    assert dense.groupBy("entity").count().filter("count <> 13").count() == 0
    back = dense.filter("a is not null").select("entity", "step", "a", "b")
    assert back.exceptAll(panel.filter("a is not null")).count() == 0


def test_wide_and_back(spark, panel):
    dense = P.densify(panel, "entity", "step", ["a", "b"])
    wide = P.panel_to_wide(dense, "entity", ["a", "b"])
    static, long = P.wide_to_panel(wide.withColumn("name", F.lit("x")), "entity")
    assert static.columns == ["entity", "name"]
    assert long.select(dense.columns).exceptAll(dense).count() == 0
    assert long.count() == dense.count()


def test_wide_with_absent_columns(spark):
    wide = spark.createDataFrame([(1, 5.0, "x")], "id int, m0_w double, m3_s string")
    _, long = P.wide_to_panel(wide, "id")
    rows = {r["step"]: (r["s"], r["w"]) for r in long.collect()}
    assert len(rows) == 13 and rows[0] == (None, 5.0) and rows[3] == ("x", None) and rows[12] == (None, None)


def test_forward_fill_never_looks_ahead(spark, panel):
    dense = P.densify(panel, "entity", "step", ["a", "b"])
    got = dense.select("entity", "step", "b", W.forward_fill("b", "entity").alias("f")).toPandas()
    want = got.sort_values(["entity", "step"]).groupby("entity")["b"].ffill()
    got = got.sort_values(["entity", "step"])
    pd.testing.assert_series_equal(got["f"], want, check_names=False)


def test_repair_is_monotone_and_keeps_gaps(spark, panel):
    dense = P.densify(panel, "entity", "step", ["a"])
    fixed = W.repair_monotone(dense, "a", "entity").toPandas().sort_values(["entity", "step"])
    for _, part in fixed.groupby("entity"):
        assert part["a"].dropna().is_monotonic_increasing
    assert fixed["a"].isna().sum() == dense.filter("a is null").count()


def test_prefix_features_match_numpy(spark, panel):
    dense = P.densify(panel, "entity", "step", ["a"])
    got = W.prefix_features(dense, ["a"], "entity", raw_steps=range(13)).toPandas()
    matrix = dense.toPandas().pivot(index="entity", columns="step", values="a").fillna(0.0)
    for row in got.sample(60, random_state=1).itertuples():
        seen = matrix.loc[row.entity].to_numpy()[: row.step + 1]
        assert row.mean_a == pytest.approx(seen.mean()) and row.std_a == pytest.approx(seen.std())
        assert (row.min_a, row.max_a, row.latest_a) == (seen.min(), seen.max(), seen[-1])
        slope = np.polyfit(np.arange(len(seen)), seen, 1)[0] if len(seen) > 1 and seen.std() > 1e-8 else 0.0
        assert row.trend_a == pytest.approx(slope, abs=1e-9)
        raw = [getattr(row, f"M{i}_a") for i in range(13)]
        assert raw == list(seen) + [0.0] * (12 - row.step)


def test_sequences_and_prefix_samples(spark, panel):
    seq = P.sequences(panel, "entity", ["a", "b"])
    row = seq.filter("entity = 99").first()["sequence"]
    assert len(row) == 13 and row[4] == [1.0, 0.0] and row[5] == [0.0, 0.0]
    samples = P.progressive_samples(seq.filter("entity = 99"), "entity", 2).collect()
    assert len(samples) == 13
    by_step = {r["step"]: r for r in samples}
    assert by_step[3]["sequence"] == [[0.0, 0.0]] * 13 and by_step[5]["sequence"][4] == [1.0, 0.0]
    assert all(len(r["sequence"]) == 13 for r in samples)


def test_latest_trend(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.5), (2, 1, 0.4), (3, 1, 0.5), (3, 2, 0.3), (4, 1, 0.5), (4, 2, 0.52)],
                               "e int, t int, p double")
    got = {r["e"]: r["trend"] for r in W.latest_trend(df, "e", "p", [F.desc("t")]).collect()}
    assert got == {1: "worsening", 2: None, 3: "improving", 4: "stable"}


def test_codes_are_alphabetical_and_invertible(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "x string")
    codes = P.label_codes(df, "x")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    back = P.decode(P.encode(df, "x", codes).drop("x"), "x_code", codes, "x").select("x")
    assert sorted(str(r[0]) for r in back.collect()) == ["None", "a", "b", "b", "c"]


def test_one_hot_unseen_is_zero(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    rows = [tuple(r) for r in P.one_hot(df, "x", ["a", "b"]).collect()]
    assert rows == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_no_step_is_dropped_in_silence(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, m0_a double, m13_a double, m1200_b double")
    _, long = P.wide_to_panel(wide, "id")
    assert {(r["step"], r["a"], r["b"]) for r in long.filter("a is not null or b is not null").collect()} == {
        (0, 2.0, None), (13, 3.0, None), (1200, None, 4.0)}
    with pytest.raises(ValueError):
        P.wide_to_panel(wide, "id", steps=range(13))
    seen = spark.createDataFrame([(1, 3), (1, 15), (2, None)], "id int, step int")
    assert {tuple(r) for r in P.steps_outside(seen, "step").collect()} == {(15, 1), (None, 1)}
