"""Moments of all pairs against pandas, and how often the table is read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import moments as M, stats as S


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 3))
    x = base @ rng.normal(size=(3, 150)) + rng.normal(size=(400, 150)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5], x[:, 6] = 0.1, np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(150)])


def rows(spark, wide):
    lines = [[None if np.isnan(v) else float(v) for v in r] for r in wide.to_numpy()]
    return spark.createDataFrame(lines, ", ".join(f"{c} double" for c in wide.columns)).repartition(6)


def test_150_columns_in_one_pass(spark, wide):
    frame = rows(spark, wide).selectExpr("*")
    got = M.correlations(frame, list(wide.columns))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("MapInArrow") == 1
    table = {(r.a, r.b): r for r in got.collect()}
    want, there = wide.corr(), wide.notna().astype(int)
    n = there.T @ there
    assert len(table) == 150 * 150
    for a in ("c0", "c17", "c149"):
        for b in wide.columns:
            r = table[a, b]
            assert r.n == n.loc[a, b]
            assert (r.r is None) if b in ("c5", "c6") else r.r == pytest.approx(want.loc[a, b], abs=1e-7)
    assert table["c5", "c0"].r is None and table["c6", "c0"].n == 0


def test_parts_merge_in_any_grouping():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)) * 5 + 1e5, rng.normal(size=(60, 2))
    x[rng.random(x.shape) < 0.4] = np.nan
    whole = M._of_rows(x, y)
    for cuts in ([10, 20], [1, 2, 3, 59], [30]):
        total = None
        for part in np.split(np.arange(60), cuts):
            new = M._of_rows(x[part], y[part])
            total = new if total is None else M.merged(total, new)
        assert np.allclose(total, whole, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("few", [120, 0])
def test_non_finite_values_are_gaps_and_no_rows_give_none(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_PAIRS", few)
    frame = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (2.0, float("inf")), (3.0, 5.0), (4.0, 4.0)], "a double, b double")
    (r,) = S.pearson_pairs(frame, ["a", "b"], min_obs=2).collect()
    assert r.n == 3 and r.r == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])
    assert S.pearson_pairs(frame, ["a", "b"], min_obs=4).first().r is None
    assert S.pearson_pairs(frame.filter(F.lit(False)), ["a", "b"]).count() == 0
    assert S.pearson_pairs(frame, ["a"]).count() == 0
    apart = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert [(r.n, r.r) for r in S.pearson_pairs(apart, ["a", "b"]).collect()] == [(0, None)]


def test_wide_scale_figures_are_folded_as_rows(spark):
    """figures of many columns are those of few, without hundreds of aggregates side by side."""
    names = [f"c{i}" for i in range(S.WIDE_FIT + 3)]
    made = [tuple(None if (i + j) % 7 == 0 else float(i * j) / 3 for j in range(len(names))) for i in range(20)]
    df = spark.createDataFrame(made, ", ".join(f"{c} double" for c in names)).withColumn("c1", F.col("c2").cast("int"))
    wide, few = S.scale_fit(df, names).collect(), S.scale_fit(df, names[:5]).first()
    assert len(wide) == 1 and [c for c in wide[0].asDict()] == names
    assert all(wide[0][c]["mean"] == pytest.approx(few[c]["mean"]) and wide[0][c]["sd"] == pytest.approx(few[c]["sd"]) for c in names[:5])
    none = S.scale_fit(df.filter("c2 < -1"), names).collect()
    assert len(none) == 1 and none[0]["c1"]["mean"] is None
    plan = S.scale_fit(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stddev_pop") <= 2
