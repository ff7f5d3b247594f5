"""Reshaping between wide records and the (entity, step) panel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.fixed_values import PANEL_STEPS
from panelwright.operators.ordering import looked_up, row_numbers

WIDE_COLUMN = re.compile(r"^m(\d+)_(.+)$")


def densify(
    observed: DataFrame,
    entity: str,
    step: str,
    metrics: Sequence[str],
    steps: Sequence[int] = PANEL_STEPS,
) -> DataFrame:
    """Every step of every entity, unobserved ones with null metrics.

    ``steps`` is the domain: rows outside it are not part of the result, and
    :func:`steps_outside` counts them.

    ``observed`` holds one row per (entity, step), so an entity gathers at most one cell
    per step however many raw rows it had. The result stays partitioned by entity, which
    the per-entity windows downstream reuse without another shuffle.
    """
    cell = F.struct(*metrics)
    gathered = observed.groupBy(entity).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(step), cell))).alias("_cells")
    )
    axis = F.array(*[F.lit(s).cast("int") for s in steps])
    exploded = gathered.select(entity, "_cells", F.explode(axis).alias(step))
    found = F.try_element_at(F.col("_cells"), F.col(step))
    return exploded.select(entity, step, *[found[m].alias(m) for m in metrics])


def steps_outside(observed: DataFrame, step: str, steps: Sequence[int] = PANEL_STEPS) -> DataFrame:
    """(step, rows): what a domain of steps leaves out, null steps included."""
    inside = F.coalesce(F.col(step).isin(list(steps)), F.lit(False))
    return observed.filter(~inside).groupBy(step).agg(F.count(F.lit(1)).alias("rows"))


def wide_metrics(columns: Sequence[str]) -> list[str]:
    found = {m.group(2) for m in map(WIDE_COLUMN.match, columns) if m}
    return sorted(found)


def wide_to_panel(
    df: DataFrame, entity: str, steps: Sequence[int] | None = None, step: str = "step"
) -> tuple[DataFrame, DataFrame]:
    """(static, panel): ``m{i}_{metric}`` columns become one row per step, map-side only.

    The steps are those of ``PANEL_STEPS`` and every other one that a column names. An explicit
    ``steps`` must name them all too: a column is never dropped without a word.
    """
    metrics = wide_metrics(df.columns)
    static = df.select(*[c for c in df.columns if not WIDE_COLUMN.match(c)])
    present = set(df.columns)
    named = [m for m in map(WIDE_COLUMN.match, df.columns) if m]
    types = {m.group(2): df.schema[m.group(0)].dataType for m in reversed(named)}
    found = {int(m.group(1)) for m in named}
    if steps is None:
        steps = sorted({*PANEL_STEPS, *found})
    elif found - set(steps):
        raise ValueError(f"columns of steps {sorted(found - set(steps))} are outside the steps asked for")

    def cell(s: int, m: str) -> Column:
        name = f"m{s}_{m}"
        source = F.col(name) if name in present else F.lit(None)
        return source.try_cast(types[m]).alias(m)

    rows = [
        F.struct(F.lit(s).cast("int").alias(step), *[cell(s, m) for m in metrics])
        for s in steps
    ]
    return static, df.select(entity, F.inline(F.array(*rows)))


def panel_to_wide(
    panel: DataFrame,
    entity: str,
    metrics: Sequence[str],
    steps: Sequence[int] = PANEL_STEPS,
    step: str = "step",
    prefix: str = "m",
) -> DataFrame:
    """One row per entity with ``m{step}_{metric}``; the value list is fixed, so one pass."""
    cells = [
        F.max(F.when(F.col(step) == s, F.col(m))).alias(f"{prefix}{s}_{m}")
        for s in steps
        for m in metrics
    ]
    return panel.groupBy(entity).agg(*cells)


def join_static(static: DataFrame, per_entity: DataFrame, entity: str) -> DataFrame:
    return static.join(per_entity, entity, "left")


def sequences(
    panel: DataFrame,
    entity: str,
    metrics: Sequence[str],
    steps: Sequence[int] = PANEL_STEPS,
    step: str = "step",
) -> DataFrame:
    """One step-by-metric matrix per entity; missing cells and missing steps are zero."""
    vector = F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics])
    zeros = F.array(*[F.lit(0.0)] * len(metrics))
    gathered = panel.groupBy(entity).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(step), vector))).alias("_cells")
    )
    axis = F.array(*[F.lit(s).cast("int") for s in steps])
    matrix = F.transform(axis, lambda s: F.coalesce(F.try_element_at("_cells", s), zeros))
    return gathered.select(entity, matrix.alias("sequence"))


def progressive_samples(seq: DataFrame, entity: str, n_metrics: int, step: str = "step") -> DataFrame:
    """One sample per (entity, t): steps after t are zeroed, ``seq_len`` is t + 1."""
    zeros = F.array(*[F.lit(0.0)] * n_metrics)
    length = F.size("sequence")
    cut = seq.select(entity, "sequence", F.explode(F.sequence(F.lit(0), length - 1)).alias(step))
    kept = F.slice("sequence", F.lit(1), F.col(step) + 1)
    padding = F.array_repeat(zeros, length - F.col(step) - 1)
    return cut.select(
        entity, step, (F.col(step) + 1).alias("seq_len"), F.concat(kept, padding).alias("sequence")
    )


def one_hot(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Indicator per training-vocabulary value; unseen values give all zeros."""
    flags = [
        F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}")
        for v in vocabulary
    ]
    return df.select(*[c for c in df.columns if c != column], *flags)


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): zero-based alphabetical codes of the column's values.

    The first six bytes of a value as a number follow its order and cut the value axis.
    """
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    head = F.rpad(F.hex(F.substring(F.encode("value", "UTF-8"), 1, 6)), 12, "0")
    keyed = values.withColumn("_head", F.conv(head, 16, 10).cast("double"))
    return row_numbers(keyed, ["_head", "value"], "code").select(
        "value", (F.col("code") - 1).cast("int").alias("code")
    )


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``df`` with the code of each value; null where the table lacks it."""
    return looked_up(df, column, codes, "value", "code", f"{column}_code")


def decode(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    """``df`` with the value of each code; null where the table lacks it."""
    return looked_up(df, code, codes, "code", "value", name)
