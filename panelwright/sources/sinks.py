"""Exports: readable CSV, panel Parquet, JSON reports, case files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.text import show_date, with_unit


def readable(
    df: DataFrame, units: Mapping[str, str] | None = None, date_pattern: str = "MM/dd/yyyy"
) -> DataFrame:
    """Human-readable cells: units, dates as text, numbers at two decimals."""
    units = units or {}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if f.name in units:
            out.append(with_unit(c, units[f.name]).alias(f.name))
        elif kind in ("date", "timestamp"):
            out.append(show_date(c, date_pattern).alias(f.name))
        elif kind in ("double", "float"):
            out.append(F.bround(c, 2).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", "true").partitionBy(*partition_by).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").json(path)


def case_documents(
    cases: DataFrame, rolled: DataFrame, condition: str, month: int = 12
) -> DataFrame:
    """Case rows with signed sums per group and the full roll-up as metadata."""
    details = rolled.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "signed_sum")))).alias("shap_values"),
        F.array_sort(F.collect_list(F.struct("group", "abs_sum", "sign", "members"))).alias("shap_metadata"),
    )
    return cases.join(details, "case_id", "left").withColumns(
        {"condition": F.lit(condition), "month_of_prediction": F.lit(month)}
    )


def write_cases(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("condition").json(path)


def run_manifest(documents: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    """One row per condition: number of cases and the settings of the run."""
    pairs = [F.lit(x) for kv in settings.items() for x in kv]
    return documents.groupBy("condition").agg(F.count(F.lit(1)).alias("cases")).withColumn(
        "settings", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    )
