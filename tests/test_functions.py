"""Parsers, repairs and renderings on the kinds of mess a register contains."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright import fixed_values as V
from panelwright.functions import categories as C, dates as D, numeric as N, parsing as P, text as T


def column(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.coalesce(1).sort("i").select(fn(F.col("v"))).collect()]


def test_measures(spark):
    got = column(spark, lambda c: P.parse_measure(c, "kg"), ["45kg", "56.5 kg", "45kgs", "n/a", "", None, "nan", "1e400"])
    assert got[:5] == [45.0, 56.5, 45.0, None, None] and got[5] is None and got[6] is None
    assert column(spark, lambda c: P.parse_measure(c, "cm"), ["162.5 cm", "175CM"]) == [162.5, 175.0]


def test_ratio(spark):
    pairs = column(spark, lambda c: F.struct(*P.split_ratio(c)), ["120/80", "120 / 80", "n/a", "bp 120/80", None])
    assert [tuple(p) for p in pairs] == [(120, 80), (120, 80), (None, None), (None, None), (None, None)]


def test_saturation(spark):
    values = ["0.95", "95", "98%", "12", "n/a", "1.0", "2", "99.999 %", "", "x"]
    assert column(spark, P.parse_saturation, values) == [95, 95, 98, None, None, 100, None, 100, None, None]


def test_proportion(spark):
    assert column(spark, P.parse_proportion, ["95.5%", "0.95", "1", "x"]) == [0.955, 0.95, 1.0, None]
    assert column(spark, lambda c: P.parse_proportion(c, rescale=False), ["95%"]) == [95.0]


def test_binary_results(spark):
    values = ["Negative", " MTB not detected ", "Trace", "not done", "", "nan", None]
    assert column(spark, P.xpert_result, values) == [0, 0, 1, 1, None, None, None]
    strict = column(spark, lambda c: P.xpert_result(c, unknown="null"), values)
    assert strict == [0, 0, 1, None, None, None, None]


@pytest.mark.parametrize("text, want", [
    ("4/3/1995= ", dt.date(1995, 4, 3)),
    ("6/10/0202", None),
    ("1/1/2990", dt.date(1990, 1, 1)),
    ("13/02/2020", dt.date(2020, 2, 13)),
    ("2/13/2020", dt.date(2020, 2, 13)),
    ("2020-02-30", None),
    ("1/1/95", dt.date(1995, 1, 1)),
    ("1/1/63", dt.date(2063, 1, 1)),
    ("2023-07-05", dt.date(2023, 7, 5)),
    ("hello", None),
    ("", None),
])
def test_dates(spark, text, want):
    assert column(spark, D.parse_mixed_date, [text]) == [want]


def test_date_repairs(spark):
    born = [dt.date(2063, 5, 1), dt.date(1898, 5, 1), dt.date(1970, 5, 1), dt.date(1919, 1, 1), None]
    assert column(spark, D.fix_birth_year, born, "date") == [
        dt.date(1963, 5, 1), dt.date(1998, 5, 1), dt.date(1970, 5, 1), dt.date(2019, 1, 1), None,
    ]
    late = column(spark, lambda c: D.fix_future_year(c, 2023), [dt.date(2031, 2, 3), dt.date(2025, 2, 3)], "date")
    assert late == [dt.date(2021, 2, 3), dt.date(2025, 2, 3)]


def test_clip_keeps_missing(spark):
    assert column(spark, lambda c: N.clip(c, 10, 180), [5.0, 500.0, 50.0, None], "double") == [10, 180, 50, None]
    assert column(spark, lambda c: N.clip(c, 0, None), [-1.0, 9e9], "double") == [0, 9e9]


def test_categories(spark):
    assert column(spark, lambda c: C.map_category(c, V.SEX), ["M", "female ", "4", None]) == ["Male", "Female", None, None]
    assert column(spark, C.chest_film, ["Normal", "abnormal", "PTB minimal", None]) == [
        "Normal", "Other", "Suggestive of PTB", None]
    assert column(spark, C.rapid_test, ["not detected", "MTB Detected", "non-reactive", None]) == [
        "Not_Detected", "Detected", "Not_Detected", "Not_Done"]
    assert column(spark, C.microscopy_grade, ["1+", "ODT", "zzz", None]) == ["1+", "Not Done", "Unknown", "Unknown"]


def test_terms(spark):
    values = ["dm; htn, unknown thing", "None", "diabetic kidney disease", " . ", "DM. diabetes", None]
    assert column(spark, C.normalize_terms, values) == [
        "Diabetes Mellitus, Hypertension, Unknown Thing", "No Known Comorbidity", "Diabetic Kidney Disease",
        None, "Diabetes Mellitus", None]


def test_bins(spark):
    right = lambda c: N.cut(c, [0, 10, 20], True, ["a", "b"])
    left = lambda c: N.cut(c, [0, 10, 20], False, ["a", "b"])
    assert column(spark, right, [0, 10, 11, 20, 21], "int") == [None, "a", "b", "b", None]
    assert column(spark, left, [0, 10, 11, 20, 21], "int") == ["a", "b", "b", None, None]


def test_names():
    want = {
        "M0_%Adherence": "m0_pct_adherence", "Blood Pressure": "blood_pressure", "Xpert MTB/RIF": "xpert_mtb_rif",
        "Smear/TB Lamp": "smear_tb_lamp", "OTHERS:": "others", "DAT- supported": "dat_supported_dup",
        "Nationality": "nationality_raw", "Nationality?": "nationality", "No.": "no",
        "Risk Factor/s for Drug Resistance-Tuberculosis": "risk_factors_for_drug_resistance_tuberculosis",
    }
    assert {k: T.standardize_name(k) for k in want} == want


def test_colliding_names(spark):
    with pytest.raises(ValueError, match="collide"):
        T.standardize_columns(spark.range(1).select(F.col("id").alias("A b"), F.col("id").alias("a-b")))


def test_prompt_omits_missing_fields(spark):
    factors = F.array(F.struct(F.lit("Age").alias("feature"), F.lit(-0.25).alias("delta")))
    text = T.prompt_text([("Age", F.lit(40)), ("Site", F.lit(None).cast("string"))], F.lit(0.5), factors)
    shown = spark.range(1).select(text).first()[0]
    assert "- Age: 40" in shown and "Site" not in shown and "-25.0% impact (decreases failure risk)" in shown
    blind = T.prompt_text([("Age", F.lit(40))], F.lit(0.5), factors, blind=True)
    assert "withheld" in spark.range(1).select(blind).first()[0]


def test_feature_groups(spark):
    names = ["M3_weight", "mean_pct_adherence", "sex_Male", "is_missing_age", "M1_is_missing_weight", "zzz", "trend_zzz",
             "months_available"]
    assert column(spark, T.feature_group, names) == [
        "Body_Weight", "Treatment_Adherence", "Sex", "Missing_Indicators", "Missing_Indicators", "STATIC_zzz",
        "UNMAPPED_zzz", "Months_Available"]


def test_lineage_key_depends_on_every_part(spark):
    one = spark.range(1).select(
        T.lineage_key(F.lit("a"), F.lit("b")), T.lineage_key(F.lit("a"), F.lit("c"))
    ).first()
    assert one[0] != one[1] and len(one[0]) == 64
