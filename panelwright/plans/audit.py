"""One versioned audit report of a missing-data run, and checks of exported tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelwright.functions.text import show_date
from panelwright.operators.missing.handle import MissingResult
from panelwright.session import cut_lineage
from panelwright.sources.sinks import readable, write_csv

VERSION = 1
DATE_PATTERN = "MM/dd/yyyy"


@dataclass
class Watched:
    """A table written once, and what it holds."""

    table: DataFrame
    facts: dict = field(default_factory=dict)


def watch(df: DataFrame) -> Watched:
    """Writes ``df`` as a checkpoint and counts its rows and nulls per column in one pass over that.

    An ``Observation`` would count while the rows pass, but with one in a session Spark ML can no
    longer serialise its tasks there (Spark 4.1), so the written table is read once instead.
    """
    table = cut_lineage(df)
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    got = table.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    nulls = {c: int(got[f"n{i}"]) for i, c in enumerate(df.columns)}
    return Watched(table, {"rows": int(got["rows"]), "columns": len(df.columns), "null_cells": sum(nulls.values()), "nulls": nulls})


def audit_report(result: MissingResult, before: Mapping[str, dict], after: Mapping[str, dict], settings: Mapping[str, object]) -> dict:
    """The report as a plain document; ``before`` and ``after`` hold facts per table."""
    columns = [r.asDict() for r in result.decisions.orderBy("source", "column").collect()]
    return {
        "version": VERSION, "settings": dict(settings), "before": dict(before), "mcar_test": dict(result.mcar),
        "pathways": dict(sorted(result.counts.items())), "columns": columns, "residual_gaps": dict(result.residual), "after": dict(after),
    }


def write_audit(spark: SparkSession, report: Mapping, path: str) -> None:
    """The report as one JSON line, and last a manifest with its digest: without one it doesn't count."""
    text = json.dumps(report, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    digest = hashlib.sha256(text.encode()).hexdigest()
    manifest = json.dumps({"version": report["version"], "sha256": digest, "bytes": len(text.encode())})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_audit(spark: SparkSession, path: str) -> dict:
    """The report, if it is whole: its manifest is there and its digest agrees."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    text = spark.read.text(f"{path}/report").first()[0]
    if hashlib.sha256(text.encode()).hexdigest() != manifest["sha256"]:
        raise ValueError(f"the report under {path} is not the one its manifest names")
    if manifest["version"] > VERSION:
        raise ValueError(f"the report under {path} has version {manifest['version']}, this reads {VERSION}")
    return json.loads(text)


def audit_rows(spark: SparkSession, report: Mapping) -> DataFrame:
    """(section, name, value) of a report's figures."""
    rows = [(s, f"{t}.{k}", str(v)) for s in ("before", "after") for t, facts in report[s].items() for k, v in facts.items() if k != "nulls"]
    rows += [("before_nulls", f"{t}.{c}", str(n)) for t, facts in report["before"].items() for c, n in facts["nulls"].items()]
    rows += [("pathways", k, str(v)) for k, v in report["pathways"].items()]
    rows += [("missing_rate", f"{r['source']}.{r['column']}", f"{r['missing_rate_pct']:.2f}") for r in report["columns"]]
    return spark.createDataFrame(rows, "section string, name string, value string")


# -- exported tables ------------------------------------------------------------------------


def read_back(spark: SparkSession, path: str, schema: T.StructType, units: Mapping[str, str], date_pattern: str = DATE_PATTERN) -> DataFrame:
    """An exported readable CSV with units and dates turned back into the types of ``schema``."""
    text = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if f.name in units:
            c = F.regexp_replace(c, rf"\s*{units[f.name]}$", "")
        if f.dataType.typeName() in ("date", "timestamp"):
            c = F.to_date(c, date_pattern)
        out.append(c.try_cast(f.dataType).alias(f.name))
    return text.select(*out)


def _shown(name: str, kind: T.DataType, units: Mapping[str, str], date_pattern: str) -> Column:
    """A value as text, at the precision that an export keeps."""
    c = F.col(f"`{name}`")
    if name in units:
        return F.format_string("%.1f", F.bround(c.cast("double"), 1))
    if kind.typeName() in ("date", "timestamp"):
        return show_date(c, date_pattern)
    if kind.typeName() in ("double", "float"):
        return F.format_string("%.2f", F.bround(c.cast("double"), 2))
    return c.cast("string")


def column_digests(df: DataFrame, key: str, units: Mapping[str, str], date_pattern: str = DATE_PATTERN) -> DataFrame:
    """(column, rows, one, two): order-free digests of each column's (key, value) pairs, in one pass.

    Two sums of 64-bit hashes per column, so rows may lie in any order or number of files, and
    a changed, missing or doubled cell moves the sums of its column.
    """
    cells = []
    for f in df.schema:
        shown = F.coalesce(_shown(f.name, f.dataType, units, date_pattern), F.lit("\u0000"))
        sums = [F.sum(F.xxhash64(F.lit(salt), F.col(f"`{key}`").cast("string"), shown).cast("decimal(38,0)")) for salt in (1, 2)]
        cells.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), sums[0].alias("one"), sums[1].alias("two")))
    return df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))


def export_check(df: DataFrame, path: str, key: str, units: Mapping[str, str] | None = None) -> DataFrame:
    """(column, rows, rows_back, passed): the typed table against the CSV under ``path``, column by column."""
    units = units or {}
    back = read_back(df.sparkSession, path, df.schema, units)
    here = column_digests(df, key, units)
    there = column_digests(back, key, units).select(F.col("column").alias("_c"), F.col("rows").alias("rows_back"), F.col("one").alias("a"), F.col("two").alias("b"))
    same = F.col("one").eqNullSafe(F.col("a")) & F.col("two").eqNullSafe(F.col("b")) & (F.col("rows") == F.col("rows_back"))
    return here.join(there, F.col("column") == F.col("_c")).select("column", "rows", "rows_back", same.alias("passed"))


def readable_checks(df: DataFrame, categories: Sequence[str], measures: Mapping[str, float]) -> DataFrame:
    """(check, passed, detail): a readable table has text categories, no 0/1 columns made of them, no scaled measures.

    ``measures`` names numeric columns and the least mean that raw values of them have.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    made = sorted(c for c in kinds for k in categories if c != k and c.startswith(f"{k}_") and c[len(k) + 1:len(k) + 2].isupper())
    coded = sorted(k for k in categories if k in kinds and kinds[k] != "string")
    fixed = [("no_one_hot_columns", not made, ", ".join(made)), ("categories_are_text", not coded, ", ".join(coded))]
    means = [
        F.struct(F.lit(f"{c}_not_scaled").alias("check"), F.coalesce(F.avg(F.col(c).cast("double")) >= low, F.lit(False)).alias("passed"),
                 F.coalesce(F.format_string("mean %.1f", F.avg(F.col(c).cast("double"))), F.lit("no values")).alias("detail"))
        for c, low in measures.items() if c in kinds
    ]
    table = df.sparkSession.createDataFrame(fixed, "check string, passed boolean, detail string")
    return table.unionByName(df.agg(F.array(*means).alias("_rows")).select(F.inline("_rows"))) if means else table


def export_readable(df: DataFrame, path: str, key: str, units: Mapping[str, str] | None = None) -> DataFrame:
    """Writes the readable CSV and returns its check against the table."""
    write_csv(readable(df, units, DATE_PATTERN), path)
    return export_check(df, path, key, units)
