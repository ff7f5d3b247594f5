"""Cross-validation against a loop of single fits, and the choice among candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import validation as C
from panelwright.operators.evaluate import candidate_score, rank_metrics
from panelwright.plans import experiment as X


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    lines = []
    for i in range(300):
        y = int(rng.random() < 0.3)
        a, b = rng.normal(y * 1.5), rng.normal()
        lines.append((i, y if i % 50 else None, float(a) if i % 11 else None, float(b), 7.0))
    return spark.createDataFrame(lines, "id long, y int, a double, b double, same double")


FEATURES = ["a", "b", "same"]


@pytest.mark.parametrize("recipe", [C.Recipe("logistic"), C.Recipe("logistic", resample=True), C.Recipe("forest", options={"numTrees": 20})])
def test_folds_equal_a_loop_of_single_fits(spark, rows, recipe):
    got = C.cross_validate(rows, "id", "y", FEATURES, recipe, parallel=3).collect()
    assert sorted(r.id for r in got) == [i for i in range(300) if i % 50]
    labelled = rows.filter("y is not null")
    coded = labelled.join(
        C.stratified_folds(labelled, "id", "y").select("id", "fold"), "id").cache()
    want = {}
    for fold in range(5):
        fitted = C.fit_recipe(coded.filter(F.col("fold") != fold), "id", "y", FEATURES, recipe)
        want |= {r.id: r.probability for r in fitted.score(coded.filter(F.col("fold") == fold)).collect()}
    assert {r.id: r.probability for r in got} == pytest.approx(want, abs=1e-9)
    report = C.fold_report(spark.createDataFrame(got), "y").collect()
    aucs = [r.roc_auc for r in report]
    assert len(report) == 5 and report[0].auc_mean == pytest.approx(np.mean(aucs)) and report[0].auc_sd == pytest.approx(np.std(aucs))
    assert report[0].auc_mean > 0.6


def test_a_fold_sees_nothing_of_what_it_holds_out(rows):
    base = rows.filter("y is not null").withColumn("part", (F.col("id") % 3).cast("int"))
    wild = base.withColumn("a", F.when(F.col("part") == 0, F.col("a") * 1e6).otherwise(F.col("a")))
    recipe = C.Recipe("logistic", resample=True)
    one, two = (C.fit_recipe(df.filter("part <> 0"), "id", "y", FEATURES, recipe) for df in (base, wild))
    assert one.fill == two.fill and one.scale == two.scale
    assert np.allclose(one.model.coefficients.toArray(), two.model.coefficients.toArray())
    scored = C.cross_validate(wild, "id", "y", FEATURES, recipe, fold="part")
    assert scored.filter("fold = 0").count() == base.filter("part = 0").count()


def test_one_class_and_no_rows(rows):
    with pytest.raises(ValueError, match="only the classes"):
        C.fit_recipe(rows.filter("y = 1"), "id", "y", FEATURES, C.Recipe("logistic"))
    empty = C.cross_validate(rows.limit(0), "id", "y", FEATURES, C.Recipe("logistic"))
    assert empty.columns == ["id", "y", "fold", "probability"] and empty.count() == 0


def test_the_best_candidate_is_chosen_and_kept(spark, rows, tmp_path):
    recipes = [C.Recipe("logistic"), C.Recipe("logistic", resample=True), C.Recipe("bayes", weighted=False)]
    templates = {"low": {"a": -1.0}, "high": {"a": 3.0}}
    made = X.choose_model(rows, "id", "y", FEATURES, recipes, templates, k=3, out=str(tmp_path / "candidates"))
    table = spark.read.parquet(str(tmp_path / "candidates")).collect()
    assert sorted(r.candidate for r in table) == ["bayes", "logistic", "logistic_rebalanced"]
    best = max(table, key=lambda r: (r.candidate_score, r.candidate))
    assert [r.candidate for r in table if r.chosen] == [best.candidate] == [made.name]
    again = {r.candidate: r.candidate_score for r in candidate_score(spark.createDataFrame(table).drop("candidate_score")).collect()}
    assert again == pytest.approx({r.candidate: r.candidate_score for r in table})
    assert all(r.clinical_delta > 0.2 and 0 <= r.val_auc <= 1 and r.cv_auc_sd >= 0 for r in table)
    assert made.threshold == best.threshold
    auc = rank_metrics(made.fitted.score(rows.filter("y is not null")), "y", "probability").first()["roc_auc"]
    assert auc > 0.7


def test_rows_of_a_fit_are_spread_by_their_number(spark):
    from panelwright.session import FIT_ROWS, fit_rows

    narrow = spark.range(3 * FIT_ROWS + 1).coalesce(1)
    spread = fit_rows(narrow)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == spread.distinct().count() == 3 * FIT_ROWS + 1
    assert fit_rows(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1


def test_rows_of_a_fit_can_be_bounded_in_parts(spark, monkeypatch):
    from panelwright import session

    monkeypatch.setattr(session, "FIT_ROWS", 10)
    parts = lambda have, most: session.fit_rows(spark.range(100).repartition(have), most).rdd.getNumPartitions()
    assert [parts(1, None), parts(1, 4), parts(1, 40), parts(7, 4), parts(3, 4), parts(4, 4)] == [10, 4, 10, 4, 4, 4]
    monkeypatch.setattr(session, "FIT_ROWS", 1000)
    assert [parts(1, 4), parts(3, 4)] == [1, 3]


def test_the_forest_of_a_panel_reads_written_rows_in_no_more_parts_than_cores(spark, monkeypatch, tmp_path):
    from panelwright.catalog import modelling

    spark.range(1200).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 7 % 30).cast("int"))).alias("ts"),
        (F.col("id") % 20).alias("user_id"), F.when(F.col("id") * 13 % 50 < F.col("id") % 20 * 2, "error").otherwise("click").alias("event_type"),
        (F.col("id") % 90).cast("double").alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr("panelwright.session.FIT_ROWS", 5)
    seen, fit, evaluate = {}, modelling.M.fit_classifier, modelling.per_step_evaluation
    monkeypatch.setattr(modelling.M, "fit_classifier", lambda train, *a, **o: seen.update(train=train, options=o) or fit(train, *a, **{**o, "numTrees": 3}))
    monkeypatch.setattr(modelling, "per_step_evaluation", lambda scored, *a: seen.update(scored=scored) or evaluate(scored, *a))
    table = modelling.panel_model_per_step(spark, str(tmp_path)).collect()
    assert sorted(r["step"] for r in table) == list(range(13))
    assert seen["options"]["numTrees"] == 200
    assert seen["train"].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = seen["scored"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "UDF" not in plan


def test_candidates_share_folds_and_figures_and_the_final_fit_is_spread(spark, rows, monkeypatch):
    monkeypatch.setattr("panelwright.session.FIT_ROWS", 50)
    seen, parts, figures, fit = [], [], C.train_figures, C.fit_recipe
    for module in (C, X):
        monkeypatch.setattr(module, "train_figures", lambda *a: seen.append(1) or figures(*a))
    monkeypatch.setattr(X, "fit_recipe", lambda train, *a: parts.append(train.rdd.getNumPartitions()) or fit(train, *a))
    X.choose_model(rows.coalesce(1), "id", "y", FEATURES, [C.Recipe("logistic"), C.Recipe("logistic", weighted=False)], k=2)
    assert len(seen) == 3 and min(parts) >= 6
