"""Splits, train-only fits and metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import evaluate as E, features as X, models as M, stats as S


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(3)
    n = 900
    y = (rng.random(n) < 0.35).astype(int)
    p = np.clip(np.where(rng.random(n) < 0.33, 0.5, (y * 0.2 + rng.random(n) * 0.8)).round(2), 0, 1)
    return pd.DataFrame({"id": np.arange(n), "y": y, "p": p, "g": rng.choice(["u", "v"], n)})


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    total = last = 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total += (recall - last) * precision
        last = recall
    return total


def test_rank_metrics(spark, scored):
    df = spark.createDataFrame(scored)
    for row in E.rank_metrics(df, "y", "p", ["g"]).collect():
        part = scored[scored["g"] == row["g"]]
        assert row["roc_auc"] == pytest.approx(brute_auc(part["y"].to_numpy(), part["p"].to_numpy()))
        assert row["pr_auc"] == pytest.approx(brute_ap(part["y"].to_numpy(), part["p"].to_numpy()))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double")
    row = E.rank_metrics(df, "y", "p").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    m = E.binary_metrics(df, "y", "p").first()
    assert (m["tp"], m["fn"], m["precision"], m["specificity"]) == (0, 2, 0.0, 0.0)


@pytest.mark.parametrize("objective", ["balanced", "failure_recall", "specificity", "f1", "accuracy", "auc_recall"])
def test_threshold_search(spark, scored, objective):
    table = E.threshold_table(spark.createDataFrame(scored), "y", "p", objective=objective).toPandas()
    assert len(table) == 81
    y, p = scored["y"].to_numpy(), scored["p"].to_numpy()
    for row in table.sample(10, random_state=0).itertuples():
        hit = p >= row.threshold
        assert (row.tp, row.fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
        assert (row.fn, row.tn) == ((~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
    best = E.best_threshold(spark.createDataFrame(table)).first()
    assert best["score"] == table["score"].max()
    assert best["threshold"] == table[table["score"] == table["score"].max()]["threshold"].min()


def test_precision_floor(spark, scored):
    df = spark.createDataFrame(scored)
    table = E.threshold_table(df, "y", "p", min_precision=2.0)
    best = E.best_threshold(table).first()
    assert best["score"] is None and best["f1"] == pytest.approx(table.agg(F.max("f1")).first()[0])


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 150).cast("int"))
    first = X.stratified_split(df, "id", "y").toPandas()
    again = X.stratified_split(df.repartition(5), "id", "y").toPandas()
    assert first["id"].is_unique and len(first) == 1000
    pd.testing.assert_frame_equal(
        first.sort_values("id").reset_index(drop=True), again.sort_values("id").reset_index(drop=True))
    counts = first.groupby(["y", "split"]).size().to_dict()
    assert counts == {(1, "train"): 105, (1, "validation"): 30, (1, "test"): 15,
                      (0, "train"): 595, (0, "validation"): 170, (0, "test"): 85}
    folds = X.stratified_folds(df, "id", "y").toPandas().groupby(["y", "fold"]).size()
    assert set(folds[1]) == {30} and set(folds[0]) == {170}


def test_train_fit_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b"), (5.0, None)], "x double, t string")
    fit = X.TrainFit.learn(train, ["x", "t"])
    other = spark.createDataFrame([(None, "zz"), (100.0, None)], "x double, t string")
    rows = [r.asDict() for r in fit.apply(other).collect()]
    assert rows[0] == {"x": 3.0, "x__missing": 1.0, "t__missing": 0.0, "t_a": 0.0, "t_b": 0.0}
    assert rows[1] == {"x": 100.0, "x__missing": 0.0, "t__missing": 1.0, "t_a": 1.0, "t_b": 0.0}


def test_train_fit_encodes_a_wide_text_column(spark):
    train = spark.createDataFrame([(f"v{i:05d}",) for i in range(1500)] + [(None,), ("v00007",)], "t string")
    fit = X.TrainFit.learn(train, ["t"])
    other = spark.createDataFrame([("v00003",), ("zz",), (None,)], "t string")
    out = fit.apply(other)
    assert out.columns == ["t__missing", "t_onehot"]
    seen, unseen, gap = (r.t_onehot for r in out.collect())
    assert (seen.size, list(seen.indices), list(seen.values)) == (1500, [3], [1.0])
    assert (unseen.size, list(unseen.indices)) == (1500, []) and list(gap.indices) == [7]


def test_train_fit_of_an_empty_column_is_zero(spark):
    train = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r["x"] for r in X.TrainFit.learn(train, ["x"]).apply(train).collect()] == [0.0, 0.0]


def test_features_at_step_hide_the_future(spark):
    panel = spark.createDataFrame([(1, s, float(s + 1)) for s in range(13)], "id int, step int, d double")
    static = spark.createDataFrame([(1, 5.0)], "id int, age double")
    row = X.features_at_step(panel, static, ["d"], "id", 2).first().asDict()
    assert row["M2_d"] == 3.0 and "M3_d" not in row and row["max_d"] == 3.0 and row["months_available"] == 2
    assert row["trend_d"] == pytest.approx(1.0) and row["age"] == 5.0


def test_scaling_uses_population_sd(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    got = S.standardize(df, S.scale_fit(df, ["a", "b"]), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_outlier_caps(spark):
    values = [float(v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 1000]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = pd.Series(values)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    capped = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    want = capped.clip(capped.mean() - 3 * capped.std(), capped.mean() + 3 * capped.std())
    got = sorted(r[0] for r in S.cap_outliers(df, ["x"]).collect())
    assert got == pytest.approx(sorted(want))
    report = S.outlier_report(df, ["x"]).first()
    assert (report["iqr_outliers"], report["z_outliers"]) == (1, 0)


@pytest.mark.parametrize("kind", ["gbt", "forest", "logistic", "svm"])
def test_classifiers_learn_a_simple_rule(spark, kind):
    df = spark.range(400).select(
        "id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z")
    ).withColumn("y", (F.col("x") > 14).cast("int"))
    options = {"gbt": {"maxIter": 5}, "forest": {"numTrees": 10}}.get(kind, {})
    model = M.fit_classifier(df, ["x", "z"], "y", kind, **options)
    auc = E.rank_metrics(M.score(model, df), "y", "probability").first()["roc_auc"]
    assert auc > 0.95


def test_temperature_and_platt(spark):
    rng = np.random.default_rng(4)
    logit = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit / 2))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"logit": logit, "y": y}))
    assert M.fit_temperature(df, "logit", "y") == pytest.approx(2.0, rel=0.15)
    a, b = M.fit_platt(df, "logit", "y")
    assert a == pytest.approx(0.5, abs=0.06) and abs(b) < 0.12


def test_counterfactual_gate(spark):
    rows = spark.createDataFrame([("base", 0.4), ("low", 0.2), ("high", 0.8)], "template string, p double")
    assert M.counterfactual_gate(rows, "p").first()["accepted"]
    flipped = spark.createDataFrame([("base", 0.4), ("low", 0.8), ("high", 0.2)], "template string, p double")
    assert not M.counterfactual_gate(flipped, "p").first()["accepted"]


def test_candidate_score(spark):
    row = spark.createDataFrame([(0.9, 0.8, 0.7, 0.5, 0.3, 0.5)],
        "train_balanced double, val_balanced double, val_auc double, val_recall double, clinical_delta double, high_risk_p double")
    got = E.candidate_score(row).first()["candidate_score"]
    assert got == pytest.approx(0.6 * 0.7 + 0.4 * 0.5 - 0.075 + 0.4 + 0.15)
