"""End-to-end runs on synthetic registers and cases."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_sources import register_text

from panelwright.operators.missing.handle import null_cells
from panelwright.operators.ordering import approx_quantiles, bucket_count
from panelwright.plans.cleaning_run import run_cleaning
from panelwright.plans.explanations import evaluate_cases
from panelwright.plans.model_inputs import prepare_model_inputs
from panelwright.plans.registry import clean_registers, with_content_ids
from panelwright.sources.cases import read_cases
from panelwright.spec import TableSpec


def test_registers_to_filled_dataset(spark, tmp_path):
    rng = random.Random(9)
    core = ["No.", "Sex", "Age", "Weight", "Heart Rate", "Outcome"]
    folder = tmp_path / "in"
    folder.mkdir()
    for year in (2023, 2024):
        rows = []
        for i in range(60):
            age = rng.randint(18, 80)
            last = rng.randint(0, 2)
            months = []
            for m in range(3):
                months += (["20", str(20 * (m + 1)), "1", "95%", f"{40 + i % 9}kg", "150", "neg", ""] if m <= last else [""] * 8)
            rows.append([i, rng.choice("MF"), "" if rng.random() < 0.2 else age, f"{45 + age // 4}kg",
                         "" if age > 60 else 70 + age // 10, "Cured" if age < 60 else "Died", *months])
        (folder / f"Pacdal - {year}.csv").write_text(register_text(core, 3, rows), "utf-8")
    run = run_cleaning(spark, str(folder), str(tmp_path / "out"), imputer="linear", max_rounds=1, trees=5)
    assert run.static.count() == 120 and run.panel.count() == 120 * 13
    assert null_cells(run.static) == 0 and null_cells(run.panel) == 0
    gates = {r["check"]: r["passed"] for r in run.gates.collect()}
    assert gates["no_nulls"] and gates["no_identifiers"] and gates["all_finite"] and gates["not_empty"]
    falls = run.panel.alias("a").join(run.panel.alias("b"), "patient_id").filter(
        (F.col("b.step") == F.col("a.step") + 1) & (F.col("b.cumulative_doses_taken") < F.col("a.cumulative_doses_taken")))
    assert falls.count() == 0
    assert spark.read.csv(str(tmp_path / "out" / "wide"), header=True).count() == 120
    assert spark.read.json(str(tmp_path / "out" / "decisions")).count() == run.missing.decisions.count() > 0


def test_spec_ignores_absent_columns(spark):
    spec = TableSpec()
    assert spec.present(spark.range(1).select(F.col("id").alias("age")), spec.measures) == ["age"]


def test_model_inputs(spark):
    static = spark.range(200).select(
        "id", F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("age"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"),
        F.when(F.col("id") % 4 == 0, "Died").when(F.col("id") % 50 != 1, "Cured").alias("outcome"),
        F.lit("2024-01-02").cast("date").alias("treatment_start_date"), F.lit("leak").alias("facility"),
    )
    panel = static.select("id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("step")).withColumn(
        "dose", F.when(F.col("step") < 6, F.col("step").cast("double")))
    made = prepare_model_inputs(static, panel, "id", ["dose"])
    rows = made.table.toPandas()
    assert "facility" not in rows.columns and "outcome" not in rows.columns
    assert set(rows["split"]) == {"train", "validation", "test"} and rows.groupby("id")["split"].nunique().max() == 1
    assert len(rows) == 13 * static.filter("outcome is not null").count()
    assert not rows.isna().any().any()
    train = rows[rows["split"] == "train"]
    assert train["age"].mean() == pytest.approx(0, abs=1e-9) and train["age"].std(ddof=0) == pytest.approx(1)
    assert set(rows["kind_x"]) == {0.0, 1.0} and "age__missing" in made.features


def test_explanation_run(spark, tmp_path):
    good = {"patient_id": "a", "explanation": "Age strongly increases the risk.", "shap_values": {"Age": 0.9}}
    bad = {"patient_id": "b", "explanation": "Sex strongly increases the risk.", "shap_values": {"Age": -0.9}}
    for c in (good, bad):
        (tmp_path / f"case_{c['patient_id']}.json").write_text(json.dumps(c))
    before = spark.createDataFrame([(2, 0, 0.0)], "total_cases long, passed long, pass_rate double")
    run = evaluate_cases(read_cases(spark, str(tmp_path)), before)
    assert {r["case_id"]: r["passed"] for r in run.scored.collect()} == {"a": True, "b": False}
    assert tuple(run.summary.first()) == (2, 1, 0.5)
    assert {r["metric"]: r["delta"] for r in run.deltas.collect()}["pass_rate_delta"] == 0.5


def test_sketched_quantiles_and_bucket_count(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    assert approx_quantiles(df, ["x"], {"m": 0.5}).first()["m"] == pytest.approx(5000, abs=2)
    assert bucket_count(df) == 256


def test_a_thirteenth_month_is_parsed_like_the_others(spark):
    raw = spark.createDataFrame([("1", "45kg", "50kgs", "n/a"), ("2", None, "bad", "40")], "`No.` string, M0_Weight string, M13_Weight string, M14_Height string")
    _, panel = clean_registers(raw)
    got = {(r["step"], r["weight"], r["height"]) for r in panel.collect() if r["weight"] or r["height"]}
    assert got == {(0, 45.0, None), (13, 50.0, None), (14, None, 80.0)}


def test_ids_of_a_row_that_most_rows_repeat(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("a"))
    got = with_content_ids(rows.repartition(5), "id")
    assert got.columns == ["a", "id"] and got.select("id").distinct().count() == 3000
    numbers = sorted(int(r["id"].rsplit("-", 1)[1]) for r in got.filter("a = 'same'").collect())
    assert numbers == list(range(1, 2001))
    assert {r["id"] for r in with_content_ids(rows.coalesce(1), "id").collect()} == {r["id"] for r in got.collect()}
