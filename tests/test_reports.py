"""Permuted courses, observed schemas, aligned codes and population roll-ups on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import attribution as A, schema as S
from panelwright.plans.dashboard import population_rollup


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(e, s, float(e * 100 + s), float(-e) if s < 5 else None) for e in range(12) for s in range(6) if not (e == 3 and s == 2)]
    return spark.createDataFrame(rows, "id long, step int, a double, b double")


def test_partners_are_a_permutation_without_fixed_points(panel):
    got = A.trajectory_partners(panel, "id", 4).collect()
    for repeat in range(4):
        pairs = {r.id: r.partner for r in got if r.repeat == repeat}
        assert sorted(pairs) == sorted(pairs.values()) == list(range(12)) and all(a != b for a, b in pairs.items())
    again = A.trajectory_partners(panel.repartition(5), "id", 4).collect()
    assert sorted(got) == sorted(again)
    alone = A.trajectory_partners(panel.filter("id = 1"), "id", 2).collect()
    assert [(r.id, r.partner) for r in alone] == [(1, 1), (1, 1)]


def test_whole_courses_change_hands_together(spark, panel):
    partner = {(r.repeat, r.id): r.partner for r in A.trajectory_partners(panel, "id", 2).collect()}
    seen = {}

    def scorer(units):
        for r in units.collect():
            seen.setdefault(r.id, {})[r.step] = (r.a, r.b)
        return units.groupBy("id").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("probability"))

    labels = spark.range(12).select("id", (F.col("id") >= 6).cast("int").alias("y"))
    out = A.trajectory_importance(panel, "id", "step", {"a": ["a"], "ab": ["a", "b"]}, labels, "y", scorer, repeats=2)
    own = {e: {r.step: (r.a, r.b) for r in panel.filter(F.col("id") == e).collect()} for e in range(12)}
    for unit, course in seen.items():
        repeat, group, e = unit.split("|")
        other = own[partner[int(repeat), int(e)]] if int(repeat) >= 0 else own[int(e)]
        want = {s: ((other.get(s) or (None, None))[0], ((other.get(s) or (None, None)) if group == "ab" else v)[1]) for s, v in own[int(e)].items()}
        assert course == (own[int(e)] if int(repeat) < 0 else want)
    drops = {r.group: r.auc_drop_mean for r in out.collect()}
    assert set(drops) == {"a", "ab"} and drops["a"] == pytest.approx(drops["ab"]) and drops["a"] > 0.2


def test_schema_report(spark):
    df = spark.createDataFrame([("1", "1.5", " ", "2024-01-02", "x"), (None, "2", None, "1/2/2024", "1"), ("-3", ".5", "", "3", "y")],
                               "i string, d string, e string, m string, t string")
    got = {r.column: r for r in S.schema_report(df).collect()}
    assert {c: r.observed for c, r in got.items()} == {"i": "integer", "d": "decimal", "e": "null", "m": "text", "t": "text"}
    assert got["e"].all_null and got["e"].example is None and got["i"].nulls == 1 and got["t"].example == "x" and got["m"].example == "1/2/2024"
    empty = S.schema_report(df.limit(0)).collect()
    assert len(empty) == 5 and all(r.rows == 0 and r.observed == "null" for r in empty)


def test_codes_and_labels(spark):
    labels = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b"), (4, "c"), (5, ""), (6, "d"), (8, "lone"), (9, "e")], "k long, l string")
    codes = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4), (9, 5), (9, 6)], "k long, c int")
    got = {(r.label, r.code): (r.rows, r.first_key, r.status) for r in S.align_codes(labels, codes, "k", "l", "c").collect()}
    assert got == {
        ("a", 0): (2, 1, "aligned"), ("b", 1): (1, 3, "code_has_labels"), ("c", 1): (1, 4, "code_has_labels"), (None, 2): (1, 5, "only_code"),
        ("d", 3): (1, 6, "aligned"), (None, 4): (1, 7, "only_code"), ("lone", None): (1, 8, "only_label"),
        ("e", 5): (1, 9, "label_has_codes"), ("e", 6): (1, 9, "label_has_codes")}
    assert S.align_codes(labels.limit(0), codes.limit(0), "k", "l", "c").count() == 0


def test_population_rollup(spark):
    people = spark.createDataFrame([
        (1, "M", 20, "hrze", 0.7, 0.6, 2), (2, "F", 70, None, 0.5, 0.52, None), (3, None, None, "mdr", None, None, 9), (4, "M", 17, "hrze", 0.2, 0.4, 1)],
        "id long, sex string, age int, regimen string, latest double, previous double, days_to_treatment int")
    records = spark.createDataFrame([(1, "full"), (1, "poor"), (2, "full"), (9, "full")], "id long, adherence string")
    got = {(r.part, r.value): r for r in population_rollup(people, records, "id").collect()}
    total = got["all", "all"]
    assert (total.entities, total.on_treatment, total.improving, total.worsening, total.stable, total.without_trend) == (4, 3, 1, 1, 1, 1)
    assert total.mean_days == 4 and total.delay == "moderate" and (total.records, total.full, total.full_pct) == (3, 2, 67)
    assert got["risk", "none"].entities == 1 and got["age_band", "0-17"].improving == 1 and got["regimen", "none"].on_treatment == 0
    assert sum(r.entities for (part, _), r in got.items() if part == "sex") == 4
    none = population_rollup(people.limit(0), records.limit(0), "id").collect()
    assert [(r.part, r.entities, r.full_pct) for r in none] in ([("all", 0, None)], [])
