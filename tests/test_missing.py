"""Missing-data engine against small brute-force computations and its invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import stats as S
from panelwright.operators.missing import chained, diagnose, fill, handle, route


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 700
    a = rng.normal(50, 10, n)
    b = 2 * a + rng.normal(0, 5, n)
    c = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c})
    pdf.loc[a > 60, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    pdf["gone"] = np.nan
    return pdf


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if pdf[c].dtype == float else F.col(c) for c in pdf.columns
    ])


def brute_mcar(pdf, columns):
    num = pdf[columns].dropna(axis=1, how="all")
    mu, var = num.mean(), num.var().clip(lower=1e-10)
    d2 = dof = patterns = 0
    for _, part in num.groupby(num.isna().apply(tuple, axis=1)):
        seen = part.columns[part.notna().all()]
        if len(part) < 2 or len(seen) == 0:
            continue
        patterns += 1
        d2 += len(part) * (((part[seen].mean() - mu[seen]) ** 2) / var[seen]).sum()
        dof += len(seen)
    return d2, dof - int(num.isna().any().sum()), patterns


def test_mcar_statistic(spark, table):
    columns = ["a", "b", "c", "gone"]
    got = diagnose.mcar_test(to_spark(spark, table), columns)
    d2, dof, patterns = brute_mcar(table, columns)
    assert got["chi2"] == pytest.approx(d2) and got["df"] == dof and got["n_patterns"] == patterns
    assert got["is_mcar"] is False and got["p_value"] < 1e-6


def test_mcar_needs_two_columns(spark, table):
    assert diagnose.mcar_test(to_spark(spark, table), ["a", "gone"])["is_mcar"] is None


def test_tails_match_known_values():
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert S.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert S.chi2_tail(0.5, 10) == pytest.approx(0.9999934, rel=1e-6)
    assert S.beta_tail(0.5, 2, 2) == pytest.approx(0.5)
    # r = 0.632 with ten pairs sits at the two-sided 5 percent point
    assert S._correlation_p(0.6318968, 10) == pytest.approx(0.05, rel=1e-4)


def test_missingness_correlation(spark, table):
    got = {r["column"]: r for r in diagnose.missingness_correlation(to_spark(spark, table), ["a", "b", "c"]).collect()}
    filled = table[["a", "c"]].fillna(table[["a", "c"]].median())
    want = filled.corrwith(table["b"].isna().astype(float)).abs()
    assert set(got) == {"b", "c"}
    assert got["b"]["max_abs_corr"] == pytest.approx(round(want.max(), 4), abs=1e-4)
    assert got["b"]["top_predictors"].split(", ")[0] == "a"


def test_dropout(spark):
    rows = [(e, s, None if e < s * 3 else 1.0, None if (e + s) % 4 == 0 else 1.0) for e in range(40) for s in range(13)]
    panel = spark.createDataFrame(rows, "id int, step int, leaving double, noisy double")
    got = {r["column"]: r["pattern"] for r in diagnose.dropout_pattern(panel, ["leaving", "noisy"]).collect()}
    assert got == {"leaving": "MNAR_dropout", "noisy": "random"}
    short = panel.filter("step < 2")
    assert {r["pattern"] for r in diagnose.dropout_pattern(short, ["leaving"]).collect()} == {"N/A"}


def test_mechanism_priority(spark):
    rows = [("x", "MNAR_dropout", 0.9), ("y", "random", 0.5), ("z", "random", 0.1), ("w", "random", None)]
    table = spark.createDataFrame(rows, "column string, pattern string, max_abs_corr double")
    got = {r["column"]: r["mechanism"] for r in diagnose.classify_mechanism(table, True).collect()}
    assert got == {"x": "MNAR", "y": "MAR", "z": "MCAR", "w": "MCAR"}
    got = {r["column"]: r["mechanism"] for r in diagnose.classify_mechanism(table, None).collect()}
    assert got["z"] == "MNAR"


def test_routing_rules(spark):
    rows = [
        ("static", "sparse", 0.85, "MNAR", "N/A"), ("panel", "sparse", 0.85, "MNAR", "random"),
        ("static", "dull", 0.6, "MNAR", "N/A"), ("static", "few", 0.1, "MCAR", "N/A"),
        ("static", "linked", 0.3, "MAR", "N/A"), ("static", "weak", 0.3, "MAR", "N/A"),
    ]
    found = spark.createDataFrame(rows, "source string, column string, missing_rate double, mechanism string, pattern string")
    rank = spark.createDataFrame(
        [("static", "sparse", 0.1), ("static", "dull", 0.0), ("static", "few", 0.2), ("static", "linked", 0.5),
         ("static", "weak", 0.05), ("panel", "sparse", 0.15)], "source string, column string, importance double")
    def routes(n, ranking, cfg=route.RouteConfig()):
        table = route.route_columns(found, ranking, n, cfg)
        return {(r["source"], r["column"]): r["pathway"] for r in table.collect()}
    got = routes(1000, rank)
    assert got[("static", "sparse")] == "drop" and got[("panel", "sparse")] == "indicator"
    assert got[("static", "dull")] == "drop" and got[("static", "few")] == "listwise"
    assert got[("static", "linked")] == "impute" and got[("static", "weak")] == "indicator"
    assert routes(500, rank)[("static", "few")] == "indicator"
    alone = routes(1000, None)
    assert alone[("static", "dull")] == "indicator" and alone[("static", "weak")] == "impute"


def test_listwise_cascades(spark, table):
    static = to_spark(spark, table)
    panel = static.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    kept, left = fill.listwise(static, panel, ["b", "c"], "id")
    assert kept.count() == len(table.dropna(subset=["b", "c"]))
    assert left.count() == 3 * kept.count()


def test_indicator_fill(spark, table):
    got = fill.indicator_fill_static(to_spark(spark, table), ["b"]).toPandas().sort_values("id")
    assert (got["is_missing_b"].to_numpy() == table["b"].isna().to_numpy()).all()
    assert got["b"].to_numpy() == pytest.approx(table["b"].fillna(table["b"].median()).to_numpy())


@pytest.mark.parametrize("kind", ["linear", "forest"])
def test_chained_imputation(spark, table, kind):
    df = to_spark(spark, table[["id", "a", "b", "c"]])
    got = chained.chained_impute(df, ["a", "b", "c"], kind=kind, max_rounds=3).toPandas().sort_values("id")
    assert list(got.columns) == ["id", "a", "b", "c"]
    assert not got.isna().any().any()
    for c in ("a", "b", "c"):
        seen = table[c].notna().to_numpy()
        assert got[c].to_numpy()[seen] == pytest.approx(table[c].to_numpy()[seen])
    gap = table["b"].isna().to_numpy()
    truth = 2 * table["a"].to_numpy()[gap]
    error = np.abs(got["b"].to_numpy()[gap] - truth).mean()
    assert error < np.abs(table["b"].median() - truth).mean()


def test_iteration_count():
    assert [chained.iteration_count(r) for r in (0.05, 0.4, 3.0)] == [20, 40, 100]


def test_handle_missing_leaves_no_gaps(spark, table):
    pdf = table.copy()
    pdf["kind"] = np.where(pdf["a"] > 55, "x", "y")
    pdf.loc[::9, "kind"] = None
    pdf["outcome"] = np.where(pdf["b"].fillna(0) > 100, "Cured", "Died")
    static = to_spark(spark, pdf)
    rng = np.random.default_rng(2)
    rows = [(i, s, None if rng.random() < s / 15 else float(s)) for i in range(len(pdf)) for s in range(13)]
    panel = spark.createDataFrame(rows, "id int, step int, dose double").withColumn("id", F.col("id").cast("long"))
    done = handle.handle_missing(
        static, panel, "id", ["a", "b", "c", "gone", "kind", "outcome"], ["dose"], label="outcome",
        imputer="linear", max_rounds=2, trees=5,
    )
    assert handle.null_cells(done.static) == 0 and handle.null_cells(done.panel) == 0
    picked = {(r["source"], r["column"]): r["pathway"] for r in done.decisions.collect()}
    assert picked[("static", "gone")] == "drop" and "gone" not in done.static.columns
    assert picked[("panel", "dose")] == "indicator" and "is_missing_dose" in done.panel.columns
    assert all(r["rationale"] for r in done.decisions.collect())
    assert sum(done.counts.values()) == len(picked)
