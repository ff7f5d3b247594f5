"""Audit tables: missingness, counts, quality, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.ordering import exact_quantiles, keyed_values, long_values

CHUNK = 300


def one_pass(df: DataFrame, columns: Sequence[str], stats: Mapping[str, object]) -> DataFrame:
    """(column, stat...) rows from one aggregation over all columns.

    ``stats`` maps a name to a function Column -> aggregate Column. The wide aggregate is
    split at ``CHUNK`` expressions so that generated code stays inside the JVM method limit.
    """
    per_chunk = max(1, CHUNK // max(1, len(stats)))
    out = None
    for at in range(0, len(columns), per_chunk):
        part = columns[at : at + per_chunk]
        aggs = [
            F.struct(F.lit(c).alias("column"), *[f(F.col(c)).alias(n) for n, f in stats.items()])
            for c in part
        ]
        rows = df.agg(F.array(*aggs).alias("_rows")).select(F.inline("_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_by_column(df: DataFrame, columns: Sequence[str], exclude_at: float = 80.0) -> DataFrame:
    """Missing count and percentage per column, with the column-exclusion flag."""
    counts = one_pass(
        df,
        columns,
        {"missing": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))},
    )
    pct = F.col("missing") * 100.0 / F.col("rows")
    return counts.select(
        "column",
        "missing",
        F.round(pct, 2).alias("missing_pct"),
        (pct >= exclude_at).alias("excluded"),
    )


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fraction missing per column, columns without gaps left out."""
    rates = one_pass(df, columns, {"rate": lambda c: F.avg(c.isNull().cast("double"))})
    return rates.filter("rate > 0")


def missing_by_group(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Missing percentage of every column inside every group, as (by, column, pct) rows."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias("missing_pct"),
        )
        for c in columns
    ]
    return df.groupBy(by).agg(F.array(*cells).alias("_rows")).select(by, F.inline("_rows"))


def step_missing_rate(panel: DataFrame, metrics: Sequence[str], step: str = "step") -> DataFrame:
    cells = [
        F.struct(
            F.lit(m).alias("column"), F.avg(F.col(m).isNull().cast("double")).alias("missing_rate")
        )
        for m in metrics
    ]
    return panel.groupBy(step).agg(F.array(*cells).alias("_rows")).select(step, F.inline("_rows"))


def all_null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    rows = one_pass(df, columns, {"present": lambda c: F.count(c)}).filter("present = 0")
    return sorted(r["column"] for r in rows.collect())


def drop_uninformative(df: DataFrame, listed: Sequence[str] = ()) -> DataFrame:
    """Without all-null columns, listed columns and phase start / end dates."""
    candidates = [c for c in df.columns if c not in listed]
    gone = set(all_null_columns(df, candidates)) | set(listed)
    gone |= {c for c in df.columns if "phase_start" in c or "phase_end" in c}
    return df.drop(*gone)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts including null; percentages are of the kept rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if top is not None:
        counts = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 2))


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def crosstab(
    df: DataFrame, rows: str, column: str, values: Sequence[str], percent: bool = True
) -> DataFrame:
    """One row per ``rows`` value, one column per listed value; row percentages or counts."""
    observed = F.col(column).isNotNull()
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    wide = df.groupBy(rows).agg(*cells, F.count_if(observed).alias("_total"))
    if not percent:
        return wide.drop("_total")
    shares = [
        F.coalesce(F.round(F.try_divide(F.col(f"`{v}`") * 100.0, F.col("_total")), 2), F.lit(0.0)).alias(v)
        for v in values
    ]
    return wide.select(rows, *shares)


def quartiles(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return exact_quantiles(df, columns, probs, by, few_groups=few_groups)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, mean, median, sample sd, extremes, population skew and excess kurtosis, missing %."""
    moments = one_pass(
        df,
        columns,
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(c.cast("double")),
            "sd": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
            "skewness": lambda c: F.skewness(c.cast("double")),
            "kurtosis": lambda c: F.kurtosis(c.cast("double")),
            "missing_pct": lambda c: F.avg(c.isNull().cast("double")) * 100,
        },
    )
    middle = exact_quantiles(df, columns, {"median": 0.5}).select("column", "median")
    return moments.join(middle, "column", "left")


def kpi_table(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value) rows; every metric is an aggregate evaluated in the same pass."""
    rows = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in metrics.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def quality_table(df: DataFrame, critical: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Completeness on the critical fields and over all cells."""
    complete = None
    for c in critical:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    filled = sum((F.count(c) for c in columns), F.lit(0))
    rows = F.count(F.lit(1))
    metrics = {
        "total_records": rows,
        "complete_records": F.count_if(complete),
        "completeness_rate": F.count_if(complete) * 100.0 / rows,
        **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in critical},
        "average_completeness": filled * 100.0 / (rows * len(columns)),
    }
    return kpi_table(df, metrics)


def cardinality_audit(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """Distinct values, missing cells and most common raw values of each column."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(
        F.count_if(F.col("value").isNotNull()).alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    best = counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    shown = best.groupBy("column").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("_r", F.coalesce("value", F.lit("nan")).alias("v")))
                ),
                lambda s: s["v"],
            ),
            ", ",
        ).alias("top_values")
    )
    return totals.join(shown, "column", "left")


def retention_cascade(
    panel: DataFrame, metrics: Sequence[str], focus: str, step: str = "step"
) -> DataFrame:
    """Per step: entities with any metric, retained and lost %, observations of ``focus``.

    Every entity has one row at every step of a dense panel, so the row count of a step is
    the number of entities.
    """
    seen = F.coalesce(*[F.col(m).cast("string") for m in metrics]).isNotNull()
    active = panel.groupBy(step).agg(
        F.count_if(seen).alias("active"),
        F.count(F.lit(1)).alias("_entities"),
        F.count(focus).alias("focus_obs"),
    )
    pct = F.col("active") * 100.0 / F.col("_entities")
    return active.select(
        step,
        "active",
        F.round(pct, 2).alias("retained_pct"),
        F.round(100 - pct, 2).alias("decay_pct"),
        "focus_obs",
    )


def entity_observation(
    panel: DataFrame, metrics: Sequence[str], entity: str, last_step: int = 7, step: str = "step"
) -> DataFrame:
    """Observed means over steps 0..``last_step``, last attended step (-1: none), steps seen."""
    inside = F.col(step) <= last_step
    seen = F.coalesce(*[F.col(m).cast("string") for m in metrics]).isNotNull() & inside
    return panel.groupBy(entity).agg(
        *[F.avg(F.when(inside, F.col(m))).alias(f"mean_{m}") for m in metrics],
        F.coalesce(F.max(F.when(seen, F.col(step))), F.lit(-1)).alias("last_step"),
        F.count_if(seen).alias("steps_observed"),
    )


def date_anomalies(
    df: DataFrame, dates: Mapping[str, Column], latest_year: int = 2026, earliest_year: int = 1920
) -> DataFrame:
    """(column, parsed, unparseable, future, too_old) per date expression, in one pass."""
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.count(d).alias("parsed"),
            F.count_if(d.isNull()).alias("unparseable"),
            F.count_if(F.year(d) > latest_year).alias("future"),
            F.count_if(F.year(d) < earliest_year).alias("too_old"),
        )
        for name, d in dates.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def order_violations(
    df: DataFrame, dates: Mapping[str, Column], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """(earlier, later, compared, violations) per pair of dates that must follow each other."""
    rows = [
        F.struct(
            F.lit(a).alias("earlier"), F.lit(b).alias("later"),
            F.count_if(dates[a].isNotNull() & dates[b].isNotNull()).alias("compared"),
            F.count_if(dates[b] < dates[a]).alias("violations"),
        )
        for a, b in pairs
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts, majority/minority ratio and balanced class weights, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).filter(F.col(label).isNotNull())
    facts = counts.agg(
        F.struct(
            F.sum("count").alias("total"), F.count(F.lit(1)).alias("classes"),
            F.max("count").alias("largest"), F.min("count").alias("smallest"),
        )
    ).scalar()
    return counts.withColumn("_f", facts).select(
        label,
        "count",
        (F.col("_f.largest") / F.col("_f.smallest")).alias("imbalance_ratio"),
        (F.col("_f.total") / (F.col("_f.classes") * F.col("count"))).alias("weight"),
    )


def sorted_set(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, values): sorted distinct list. Copies are removed before anything is gathered,
    so a list is as long as the group's vocabulary, not as its row count."""
    distinct = df.select(by, value).filter(F.col(value).isNotNull()).distinct()
    return distinct.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("values"))


def best_by(df: DataFrame, by: Sequence[str], score: Column, tie: str) -> DataFrame:
    """Highest-scoring whole row of each group (of the table when ``by`` is empty)."""
    row = F.struct(*df.columns)
    best = F.max_by(row, F.struct(score.alias("s"), F.col(tie)))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(best.alias("_best")).select("_best.*")


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 30
) -> DataFrame:
    """Equal-width counts and densities per measure between its own extremes."""
    limits = one_pass(
        df,
        columns,
        {
            "low": lambda c: F.min(c.cast("double")),
            "high": lambda c: F.max(c.cast("double")),
            "n": lambda c: F.count(c),
        },
    )
    facts = keyed_values(limits.select("column", F.struct("low", "high", "n").alias("f")), "column", "f")
    rows = long_values(df, columns).withColumn("_f", F.try_element_at(facts, F.col("column")))
    rows = rows.select("column", "value", "_f.low", "_f.high", "_f.n")
    width = (F.col("high") - F.col("low")) / bins
    at = F.floor((F.col("value") - F.col("low")) / F.when(width > 0, width))
    placed = rows.withColumn(
        "bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    )
    counted = placed.groupBy("column", "bin", "low", "high", "n").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select(
        "column",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("left_edge"),
        "count",
        F.try_divide(F.col("count"), F.col("n") * width).alias("density"),
    )


def quality_gates(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """(check, passed, detail) rows: no identifiers, no nulls, no text, all finite, not empty."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    leaked = sorted(set(identifiers) & set(df.columns))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("long"))
    odd = sum(
        (
            F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
            for c in numeric
        ),
        F.lit(0).cast("long"),
    )
    rows = F.count(F.lit(1))

    def check(name: str, failures: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), (failures == 0).alias("passed"), failures.alias("failures")
        )

    checks = [
        check("no_identifiers", F.max(F.lit(len(leaked)).cast("long"))),
        check("no_nulls", nulls),
        check("no_text_columns", F.max(F.lit(len(text)).cast("long"))),
        check("all_finite", odd),
        check("not_empty", F.when(rows > 0, 0).otherwise(1).cast("long")),
    ]
    return df.agg(F.array(*checks).alias("_rows")).select(F.inline("_rows"))
