"""Attribution roll-ups and explanation scoring rules."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import attribution as A, explain as X


def claims_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "case_id int, t string")
    rows = X.claims(df, "t", "case_id").collect()
    out = {i: {} for i in range(len(texts))}
    for r in rows:
        out[r["case_id"]][r["feature"]] = (r["direction"], r["magnitude"])
    return [out[i] for i in range(len(texts))]


def test_claims(spark):
    got = claims_of(
        spark,
        "Treatment Adherence strongly increases the risk.",
        "Body weight slightly lowers the risk.",
        "The Smear Result had a mixed effect, and it increases nothing else.",
        "Xpert Result varied.",
        "Age is known. " + "x" * 300 + " increases",
        "Nothing here increases.",
        "Case Registration Group raises the risk",
    )
    assert got[0] == {"Treatment Adherence": ("increase", "strong")}
    assert got[1] == {"Body Weight": ("decrease", "weak")}
    assert got[2] == {"Smear Result": ("increase", "unspecified")}
    assert got[3] == {"Xpert Result": ("mixed", "unspecified")}
    assert got[4] == {} and got[5] == {}
    assert set(got[6]) == {"Registration Group", "Case Registration Group"}


def test_whole_words_only(spark):
    assert claims_of(spark, "Height flowers and éraises étc.") == [{}]


def test_magnitude_is_sought_only_where_it_is_read(spark):
    """whether a case has a claim takes no pattern of the magnitudes."""
    df = spark.createDataFrame([(1, "Age raises the risk moderately.")], "case_id int, t string")
    claimed = X.claims(df, "t", "case_id")

    def plan(table):
        return table._jdf.queryExecution().optimizedPlan().toString()

    assert "moderately" in plan(claimed) and "moderately" not in plan(claimed.select("case_id").distinct())


def test_names_and_phrases_beside_other_words_and_scripts(spark):
    got = claims_of(spark, "ÄÖ 𝒳 age_x raise𝒳 lowers; Xpert MTB/RIF", None, "", "Smear/TB Lamp was both increased and decreased")
    assert got == [{"Age": ("decrease", "unspecified"), "Xpert MTB/RIF": ("decrease", "unspecified")}, {}, {},
                   {"Smear/TB Lamp": ("mixed", "unspecified"), "TB Lamp": ("mixed", "unspecified")}]
    df = spark.createDataFrame([(1, "ÄÖ 𝒳 age lowers")] * 2, "case_id int, t string")
    assert [r["position"] for r in X.claims(df, "t", "case_id").collect()] == [6, 6]


def test_names_are_not_compared_at_every_place_of_a_text(spark):
    df = spark.createDataFrame([(1, "Age raises")], "case_id int, t string")
    plan = X.claims(df, "t", "case_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Contains(_t" not in plan


def test_empty_phrase_lists(spark):
    df = spark.createDataFrame([(1, "Age raises the risk."), (2, None)], "case_id int, t string")
    got = X.claims(df, "t", "case_id", decrease=[], mixed=["no such words"], magnitudes=[]).collect()
    assert [tuple(r) for r in got] == [(1, "Age", "increase", "unspecified", 1)]


def test_truth_rows(spark):
    rows = [("p", f, v) for f, v in [("a", 1.0), ("b", -0.31), ("c", 0.29), ("d", 0.0), ("e", -0.5), ("f", 0.1)]]
    table = spark.createDataFrame(rows, "case_id string, feature string, value double")
    got = {r["feature"]: r for r in X.truth_rows(table).collect()}
    assert set(got) == {"a", "e", "b", "c", "f"}
    assert (got["a"]["rank"], got["e"]["rank"], got["b"]["sign"]) == (1, 2, "decrease")
    assert got["b"]["magnitude_band"] == "strong" and got["c"]["magnitude_band"] == "moderate"
    with pytest.raises(ValueError):
        X.truth_rows(table, k=0)


def score(spark, truth, claims, cases=("p",)):
    t = spark.createDataFrame(truth, "case_id string, feature string, sign string, magnitude_band string")
    c = spark.createDataFrame(claims, "case_id string, feature string, direction string, magnitude string, position int")
    names = spark.createDataFrame([(c,) for c in cases], "case_id string")
    return {r["case_id"]: r for r in X.score_cases(t, c, names).collect()}


def test_scores(spark):
    truth = [("p", "Age", "increase", "strong"), ("p", "Sex", "decrease", "moderate")]
    perfect = [("p", "Age", "increase", "strong", 1), ("p", "Sex", "decrease", "moderate", 2)]
    got = score(spark, truth, perfect)["p"]
    assert got["composite"] == 1.0 and got["passed"] and got["failure_tags"] == []
    empty = score(spark, truth, [])["p"]
    assert empty["composite"] == 0.0 and not empty["passed"] and len(empty["failure_tags"]) == 4
    wrong = score(spark, truth, [("p", "Age", "decrease", "strong", 1), ("p", "Sex", "decrease", "moderate", 2)])["p"]
    assert wrong["sign_accuracy"] == 0.5 and wrong["composite"] == pytest.approx(0.825)
    assert wrong["failure_tags"] == ["low_sign_accuracy"] and not wrong["passed"]
    both = score(spark, [], [], cases=("q",))["q"]
    assert both["composite"] == 1.0 and both["passed"]


def test_alias_twice_keeps_the_later_mention(spark):
    truth = [("p", "Age", "increase", "strong")]
    claims = [("p", "Age", "decrease", "strong", 1), ("p", "Age", "increase", "strong", 9)]
    assert score(spark, truth, claims)["p"]["sign_accuracy"] == 1.0


def test_summary_and_run_comparison(spark):
    rows = spark.createDataFrame([(True,), (False,), (False,)], "passed boolean")
    assert tuple(X.run_summary(rows).first()) == (3, 1, 0.333333)
    a = spark.createDataFrame([("x", 0.5), ("gone", 0.2)], "metric string, value double")
    b = spark.createDataFrame([("x", 0.75), ("new", 0.1)], "metric string, value double")
    got = {r["metric"]: r["delta"] for r in X.compare_runs(a, b).collect()}
    assert got == {"x_delta": 0.25, "gone_delta": -0.2, "new_delta": 0.1}


def test_canonical_names(spark):
    names = ["Smear/TB Lamp", "chest x-ray", "Body_Weight", "vitals", "BMI"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").coalesce(1).sort("i")
    got = [r[0] for r in df.select(X.canonical_name(F.col("n"))).collect()]
    assert got == ["Smear_Result", "Chest_Xray", "Body_Weight", "Vital_Signs", "BMI"]


def test_case_issues(spark):
    cases = spark.createDataFrame(
        [("a", "Age increases it", {"Age": 1.0}), ("b", None, {"Nope": 1.0}), ("c", "nothing", None)],
        "case_id string, explanation string, attributions map<string,double>")
    found = X.claims(cases, "explanation", "case_id")
    got = {r["case_id"]: r["issues"] for r in X.case_issues(cases, found).collect()}
    assert got == {"a": [], "b": ["missing_explanation", "unknown_keys: Nope"], "c": ["missing_attributions", "no_claims"]}


def test_roll_up(spark):
    rows = spark.createDataFrame(
        [("p", "sex_M", 0.3), ("p", "sex_F", -0.1), ("p", "age", -0.2), ("p", "odd", 1e-9)],
        "case_id string, feature string, value double")
    groups = spark.createDataFrame(
        [("sex_M", "Sex"), ("sex_F", "Sex"), ("age", "Age"), ("odd", "Flat")], "feature string, group string")
    got = {r["group"]: r for r in A.roll_up(rows, groups).collect()}
    assert got["Sex"]["signed_sum"] == pytest.approx(0.2) and got["Sex"]["abs_sum"] == pytest.approx(0.4)
    assert (got["Sex"]["sign"], got["Age"]["sign"], got["Flat"]["sign"]) == ("+", "-", "mixed")
    assert [r["group"] for r in A.top_groups(A.roll_up(rows, groups), 1).collect()] == ["Sex"]
    assert A.uncovered(rows, groups.filter("feature <> 'age'")).collect()[0][0] == "age"


def test_shuffle_is_a_permutation(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    dealt = A.shuffled_column(df, "id", ["x", "z"], repeats=2).toPandas()
    for (feature, repeat), part in dealt.groupby(["feature", "repeat"]):
        want = sorted(float(i) if feature == "x" else float(i % 7) for i in range(400))
        assert sorted(part["new_value"]) == want and part["id"].is_unique
    x = dealt[(dealt.feature == "x") & (dealt.repeat == 0)]
    assert (x["id"] != x["new_value"]).mean() > 0.9


def test_permutation_importance_finds_the_feature(spark):
    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"))
    df = df.withColumn("y", (F.col("x") >= 5).cast("int"))
    scorer = lambda d: d.withColumn("probability", F.col("x") / 10)
    got = {r["feature"]: r for r in A.permutation_importance(df, "id", "y", ["x", "z"], scorer, repeats=3).collect()}
    assert got["x"]["auc_drop_mean"] > 0.4 and got["z"]["auc_drop_mean"] == pytest.approx(0.0)
    assert got["z"]["auc_drop_std"] == pytest.approx(0.0) and got["x"]["f1_drop_mean"] > 0.3


def test_occlusion(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 0.0)], "id int, a double, b double, is_missing_a double")
    scorer = lambda d: d.withColumn("probability", 0.1 * F.col("a") - 0.3 * F.col("b") + 0.2 * F.col("is_missing_a"))
    got = {r["group"]: r for r in A.occlusion(
        df, "id", {"A": ["a", "is_missing_a"], "B": ["b"], "none": ["zz"]}, scorer, {"is_missing_a": 1.0}).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["delta"] == pytest.approx(0.0) and got["B"]["delta"] == pytest.approx(0.3)
    assert got["B"]["direction"] == "protective"
