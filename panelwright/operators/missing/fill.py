"""Deterministic treatments: drop, listwise, indicator and fill, clip, safety net."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright import fixed_values as V
from panelwright.functions.numeric import clip
from panelwright.operators.ordering import attach, medians, modes
from panelwright.operators.profile import one_pass
from panelwright.operators.windows import forward_fill, repair_monotone

NUMERIC = ("double", "float", "integer", "long", "short", "byte")


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return [c for c in columns if kinds[c] in NUMERIC]


def listwise(
    static: DataFrame, panel: DataFrame, columns: Sequence[str], entity: str
) -> tuple[DataFrame, DataFrame]:
    """Static rows complete on ``columns``, and the panel rows of the entities kept."""
    kept = static.dropna(subset=list(columns))
    return kept, panel.join(kept.select(entity), entity, "left_semi")


def add_indicators(df: DataFrame, columns: Sequence[str], prefix: str = "is_missing_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": F.col(c).isNull().cast("int") for c in columns})


def fill_central(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Median for numeric columns, most frequent value for text; zero or ``Unknown`` for a
    column without a single observed value."""
    fit_on = df if fit_on is None else fit_on
    numbers = numeric_columns(df, columns)
    texts = [c for c in columns if c not in numbers]
    if numbers:
        df = attach(df, medians(fit_on, numbers), "_median")
        df = df.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median.{c}"), F.lit(0.0)) for c in numbers}
        ).drop("_median")
    if texts:
        df = attach(df, modes(fit_on, texts), "_mode")
        df = df.withColumns(
            {c: F.coalesce(c, F.col(f"_mode.{c}"), F.lit("Unknown")) for c in texts}
        ).drop("_mode")
    return df


def indicator_fill_static(static: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_central(add_indicators(static, columns), columns)


def carry_forward(panel: DataFrame, columns: Sequence[str], entity: str, step: str = "step") -> DataFrame:
    filled = {c: forward_fill(c, entity, step) for c in columns}
    return panel.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in panel.columns])


def indicator_fill_panel(
    panel: DataFrame, columns: Sequence[str], entity: str, step: str = "step"
) -> DataFrame:
    """Indicators, then past-only fill, then the global median or mode for opening gaps.

    Nothing is filled backwards: a later measurement is not known at an earlier step.
    """
    marked = add_indicators(panel, columns)
    return fill_central(carry_forward(marked, columns, entity, step), columns)


def residual_gaps(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """(column, missing) of the columns that still have gaps, from one pass."""
    columns = [c for c in df.columns if c not in skip]
    return one_pass(df, columns, {"missing": lambda c: F.count_if(c.isNull())}).filter("missing > 0")


def safety_fill(df: DataFrame, skip: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Last resort for gaps that survived every pathway, in all columns or those given."""
    fillable = [f.name for f in df.schema if f.name not in skip
                and f.dataType.typeName() in (*NUMERIC, "string")]
    return fill_central(df, [c for c in fillable if columns is None or c in columns])


def clip_static(static: DataFrame) -> DataFrame:
    bounds = {c: b for c, b in V.STATIC_BOUNDS.items() if c in static.columns}
    out = static.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items()}) if bounds else static
    if "age" in bounds:
        out = out.withColumn("age", F.bround("age", 0).cast("long"))
    return out


def clip_panel(panel: DataFrame, entity: str, step: str = "step") -> DataFrame:
    """Plausible ranges and a non-decreasing cumulative column, after imputation."""
    bounds = {c: b for c, b in V.PANEL_BOUNDS.items() if c in panel.columns}
    out = panel.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items()}) if bounds else panel
    if V.CUMULATIVE_COLUMN in out.columns:
        out = repair_monotone(out, V.CUMULATIVE_COLUMN, entity, step)
    return out
