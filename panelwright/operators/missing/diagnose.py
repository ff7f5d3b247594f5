"""Why values are missing: MCAR test, dropout, missingness correlation, mechanism."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.operators.moments import ROUNDING, pair_moments
from panelwright.operators.ordering import attach, medians
from panelwright.operators.profile import one_pass, step_missing_rate
from panelwright.operators.stats import chi2_tail, correlation_p, group_spearman


def mcar_statistic(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (chi2, df, n_patterns, n_columns) of the diagonal missing-completely-at-random test.

    Rows are grouped by which columns they lack; each pattern's means are compared with
    the overall means. Patterns of one row or with nothing observed are left out.
    """
    profile = df.agg(
        *[F.struct(F.avg(c).alias("mu"), F.var_samp(c).alias("var"), F.count(c).alias("n"),
                   F.count(F.lit(1)).alias("rows")).alias(c) for c in columns]
    )
    pattern = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    grouped = df.groupBy(pattern.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_k"), *[F.avg(c).alias(c) for c in columns]
    )
    tested = attach(grouped, profile, "_p")
    d2, seen, gaps, live = F.lit(0.0), F.lit(0), F.lit(0), F.lit(0)
    for c in columns:
        p = F.col(f"_p.{c}")
        var = F.greatest(F.coalesce(p["var"], F.lit(1e-10)), F.lit(1e-10))
        d2 = d2 + F.coalesce(F.pow(F.col(c) - p["mu"], 2) / var, F.lit(0.0))
        seen = seen + F.col(c).isNotNull().cast("int")
        usable = p["n"] > 0
        live = live + usable.cast("int")
        gaps = gaps + (usable & (p["n"] < p["rows"])).cast("int")
    rows = tested.select(
        (F.col("n_k") * d2).alias("d2"), seen.alias("seen"), "n_k",
        gaps.alias("gaps"), live.alias("live"),
    )
    counted = (F.col("n_k") >= 2) & (F.col("seen") > 0)
    return rows.agg(
        F.coalesce(F.sum(F.when(counted, F.col("d2"))), F.lit(0.0)).alias("chi2"),
        (F.coalesce(F.sum(F.when(counted, F.col("seen"))), F.lit(0)) - F.max("gaps")).alias("df"),
        F.count_if(counted).alias("n_patterns"),
        F.max("live").alias("n_columns"),
    )


def mcar_test(df: DataFrame, columns: Sequence[str]) -> dict:
    """The statistic with its p-value; ``is_mcar`` is None where the test cannot decide."""
    row = mcar_statistic(df, columns).first()
    out = {"chi2": row["chi2"], "df": row["df"], "n_patterns": row["n_patterns"]}
    if row["n_columns"] is None or row["n_columns"] < 2:
        return {**out, "p_value": None, "is_mcar": None, "note": "needs two numeric columns"}
    if row["df"] <= 0:
        return {**out, "p_value": None, "is_mcar": None, "note": "too few patterns to decide"}
    p = chi2_tail(row["chi2"], row["df"])
    note = "cannot reject MCAR" if p > 0.05 else "MCAR rejected: at least MAR"
    return {**out, "p_value": p, "is_mcar": p > 0.05, "note": note}


def dropout_pattern(panel: DataFrame, metrics: Sequence[str], step: str = "step") -> DataFrame:
    """(column, rho, p_value, pattern): does the missing rate climb with the step?"""
    rates = step_missing_rate(panel, metrics, step)
    rho = group_spearman(rates, step, "missing_rate", "column")
    p = correlation_p(F.col("rho"), F.col("n"))
    pattern = (
        F.when(F.col("n") < 3, "N/A")
        .when((F.col("rho") > 0.6) & (p < 0.05), "MNAR_dropout")
        .otherwise("random")
    )
    return rho.select("column", "rho", p.alias("p_value"), pattern.alias("pattern"))


def missingness_correlation(
    df: DataFrame, columns: Sequence[str], predictors: Sequence[str] | None = None
) -> DataFrame:
    """(column, max_abs_corr, top_predictors) of each gap indicator with the other columns.

    Predictors must be observed in more than half of the rows and are median-filled. All
    coefficients come from one pass.
    """
    predictors = list(predictors or columns)
    wide = attach(df.select(*dict.fromkeys([*columns, *predictors])), medians(df, predictors), "_m")
    gaps = {c: F.col(c).isNull().cast("double").alias(f"gap_{i}") for i, c in enumerate(columns)}
    filled = {p: F.coalesce(F.col(p).cast("double"), F.col(f"_m.{p}")).alias(f"fill_{i}") for i, p in enumerate(predictors)}
    seen = [F.col(p).isNull().cast("double").alias(f"lack_{i}") for i, p in enumerate(predictors)]
    table = pair_moments(
        wide.select(*gaps.values(), *filled.values(), *seen), [f"gap_{i}" for i in range(len(columns))],
        [*[f"fill_{i}" for i in range(len(predictors))], *[f"lack_{i}" for i in range(len(predictors))]])
    number = F.substring_index("b", "_", -1).cast("int")
    table = table.withColumns({
        "column": F.get(F.array(*[F.lit(c) for c in columns]), F.substring_index("a", "_", -1).cast("int")),
        "predictor": F.get(F.array(*[F.lit(p) for p in predictors]), number)})
    rows = table.groupBy("column", "predictor").agg(
        F.max(F.when(F.col("b").startswith("fill_"), F.struct("n", "mean_a", "mean_b", "m2_a", "m2_b", "c"))).alias("m"),
        F.max(F.when(F.col("b").startswith("lack_"), F.col("mean_b"))).alias("lack"))
    flat = lambda s: F.col(f"m.m2_{s}") <= F.col("m.n") * F.pow(ROUNDING * F.abs(F.col(f"m.mean_{s}")), 2)
    r = F.abs(F.try_divide("m.c", F.sqrt("m.m2_a") * F.sqrt("m.m2_b")))
    out = rows.filter(F.col("column") != F.col("predictor")).select(
        "column", "predictor", F.round(F.col("m.mean_a") * F.col("m.n")).alias("gaps"),
        F.when((F.col("lack") < 0.5) & ~flat("a") & ~flat("b"), F.least(r, F.lit(1.0))).alias("r"))
    scored = out.filter("gaps > 0")
    ordered = F.array_sort(
        F.collect_list(
            F.when(
                F.col("r").isNotNull(), F.struct((-F.col("r")).alias("k"), F.col("predictor"))
            )
        )
    )
    top = F.transform(F.slice(ordered, 1, 3), lambda s: s["predictor"])
    return scored.groupBy("column").agg(
        F.round(F.coalesce(F.max("r"), F.lit(0.0)), 4).alias("max_abs_corr"),
        F.array_join(top, ", ").alias("top_predictors"),
    )


def classify_mechanism(diagnostics: DataFrame, is_mcar: bool | None) -> DataFrame:
    """Adds ``mechanism``: dropout beats correlation beats the global MCAR verdict."""
    rule = (
        F.when(F.col("pattern") == "MNAR_dropout", "MNAR")
        .when(F.coalesce("max_abs_corr", F.lit(0.0)) > 0.3, "MAR")
        .otherwise("MCAR" if is_mcar else "MNAR")
    )
    return diagnostics.withColumn("mechanism", rule)


def diagnostics(
    static: DataFrame,
    panel: DataFrame,
    static_columns: Sequence[str],
    panel_columns: Sequence[str],
    numeric: Sequence[str],
    step: str = "step",
) -> DataFrame:
    """(source, column, missing_rate, pattern, max_abs_corr) for every column with gaps.

    Static and panel columns of one name stay apart: rows are keyed by source and column.
    """
    rate = {"missing_rate": lambda c: F.avg(c.isNull().cast("double"))}
    rates = (
        one_pass(static, static_columns, rate).withColumn("source", F.lit("static"))
        .unionByName(one_pass(panel, panel_columns, rate).withColumn("source", F.lit("panel")))
        .filter("missing_rate > 0")
    )
    drops = dropout_pattern(panel, panel_columns, step).select(
        F.lit("panel").alias("source"), "column", "pattern"
    )
    links = missingness_correlation(static, numeric).select(
        F.lit("static").alias("source"), "column", "max_abs_corr"
    )
    return (
        rates.join(drops, ["source", "column"], "left")
        .join(links, ["source", "column"], "left")
        .withColumn("pattern", F.coalesce("pattern", F.lit("N/A")))
    )
