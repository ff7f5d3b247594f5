"""The audit report, its manifest, and exported tables compared with what was exported."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from panelwright.plans import audit


def test_counts_come_from_the_written_table(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    counted = rows.filter(F.udf(lambda a: seen.add(1) or True, "boolean")("a"))
    made = audit.watch(counted)
    assert made.facts == {"rows": 3, "columns": 2, "null_cells": 3, "nulls": {"a": 1, "b": 2}}
    assert made.table.count() == 3 and seen.value == 3


def test_a_report_counts_only_with_its_manifest(spark, tmp_path):
    report = {"version": 1, "before": {"t": {"rows": 2, "nulls": {"a": 1}}}, "after": {}, "pathways": {"drop": 1}, "columns": []}
    path = str(tmp_path / "audit")
    audit.write_audit(spark, report, path)
    assert audit.read_audit(spark, path) == report
    rows = {(r.section, r.name): r.value for r in audit.audit_rows(spark, report).collect()}
    assert rows == {("before", "t.rows"): "2", ("before_nulls", "t.a"): "1", ("pathways", "drop"): "1"}
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    with pytest.raises(ValueError, match="manifest"):
        audit.read_audit(spark, path)
    with pytest.raises(Exception):
        audit.read_audit(spark, str(tmp_path / "nothing"))


def test_a_changed_cell_is_found_and_named(spark, tmp_path):
    df = spark.range(50).select(
        "id", (F.col("id") / 7).alias("weight"), F.date_add(F.lit("2024-01-31").cast("date"), F.col("id").cast("int")).alias("day"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("a, \"b "), "id")).alias("note"), F.sqrt("id").alias("root"))
    path = str(tmp_path / "out")
    first = audit.export_readable(df, path, "id", {"weight": "kg"})
    assert all(r.passed and r.rows == r.rows_back == 50 for r in first.collect())
    assert all(r.passed for r in audit.export_check(df.repartition(7).orderBy(F.desc("id")), path, "id", {"weight": "kg"}).collect())
    (part,) = [f for f in glob.glob(f"{path}/part-*") if ",5.66" in open(f).read()][:1]
    text = open(part).read()
    for crc in glob.glob(f"{path}/.*.crc"):
        os.remove(crc)
    open(part, "w").write(text.replace(",5.66", ",5.67", 1))
    assert {r.column for r in audit.export_check(df, path, "id", {"weight": "kg"}).collect() if not r.passed} == {"root"}
    open(part, "w").write("\n".join(text.split("\n")[:-2]) + "\n")
    assert not any(r.passed for r in audit.export_check(df, path, "id", {"weight": "kg"}).collect())


def test_readable_checks(spark):
    good = spark.createDataFrame([("M", "Cured", 40), ("F", "Died", 50)], "sex string, outcome string, age int")
    assert all(r.passed for r in audit.readable_checks(good, ["sex", "outcome", "diagnosis"], {"age": 1.0, "weight": 1.0}).collect())
    bad = spark.createDataFrame([(0, 1, -0.1), (1, 0, 0.1)], "sex int, outcome_Died int, age double")
    got = {r.check: (r.passed, r.detail) for r in audit.readable_checks(bad, ["sex", "outcome"], {"age": 1.0}).collect()}
    assert got["no_one_hot_columns"] == (False, "outcome_Died") and got["categories_are_text"] == (False, "sex") and not got["age_not_scaled"][0]
