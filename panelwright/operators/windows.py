"""Per-entity window operators over a panel (at most one row per entity and step).

All of them use one window specification family, partitioned by entity and ordered by
step, so Spark sorts and shuffles a panel once for any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelwright.functions.numeric import trend_class


def by_step(entity: str, step: str = "step") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(step)


def up_to_now(entity: str, step: str = "step") -> WindowSpec:
    return by_step(entity, step).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward_fill(c: str, entity: str, step: str = "step") -> Column:
    """Last observed value so far. Never looks at a later step."""
    return F.last(F.col(c), ignorenulls=True).over(up_to_now(entity, step))


def running_max(c: str, entity: str, step: str = "step") -> Column:
    return F.max(F.col(c)).over(up_to_now(entity, step))


def running_sum(c: str, entity: str, step: str = "step") -> Column:
    return F.sum(F.col(c)).over(up_to_now(entity, step))


def change(c: str, entity: str, step: str = "step") -> Column:
    return F.col(c) - F.lag(c).over(by_step(entity, step))


def repair_monotone(df: DataFrame, c: str, entity: str, step: str = "step") -> DataFrame:
    """Running maximum where a value is present; gaps stay gaps."""
    fixed = F.when(F.col(c).isNotNull(), running_max(c, entity, step))
    return df.withColumn(c, fixed)


def monotone_violations(df: DataFrame, c: str, entity: str, step: str = "step") -> DataFrame:
    """Steps per entity whose value falls below the step before."""
    flagged = df.select(entity, (change(c, entity, step) < 0).alias("_falls"))
    return flagged.groupBy(entity).agg(F.count_if("_falls").alias("violations"))


def prefix_features(
    panel: DataFrame,
    metrics: Sequence[str],
    entity: str,
    step: str = "step",
    raw_steps: Sequence[int] = (),
) -> DataFrame:
    """mean / population sd / min / max / slope / latest of each metric up to each step.

    Missing cells count as zero, as in the model matrix. A flat or one-point history has
    slope zero. ``raw_steps`` adds ``M{i}_{metric}``, the cell of step i where i is not
    later than the row's step and zero otherwise.
    """
    w = up_to_now(entity, step)
    filled = panel.select(
        entity, step, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]
    )
    names = [f"M{i}_{m}" for i in raw_steps for m in metrics]
    out: list[Column] = [
        F.coalesce(F.max(F.when(F.col(step) == i, F.col(m))).over(w), F.lit(0.0)).alias(f"M{i}_{m}")
        for i in raw_steps
        for m in metrics
    ]
    for m in metrics:
        out += [
            F.avg(m).over(w).alias(f"mean_{m}"),
            F.stddev_pop(m).over(w).alias(f"std_{m}"),
            F.min(m).over(w).alias(f"min_{m}"),
            F.max(m).over(w).alias(f"max_{m}"),
            F.regr_slope(F.col(m), F.col(step).cast("double")).over(w).alias(f"_slope_{m}"),
            F.col(m).alias(f"latest_{m}"),
        ]
    wide = filled.select(entity, step, *out)
    final = []
    for m in metrics:
        slope = F.when(F.col(f"std_{m}") > 1e-8, F.col(f"_slope_{m}"))
        final += [
            *[F.col(f"{a}_{m}") for a in ("mean", "std", "min", "max")],
            F.coalesce(slope, F.lit(0.0)).alias(f"trend_{m}"),
            F.col(f"latest_{m}"),
        ]
    return wide.select(entity, step, *names, *final, F.col(step).alias("months_available"))


def contiguous(df: DataFrame, entity: str, step: str = "step") -> Column:
    """True where the row's step is the expected next one (previous + 1, or 0 / 1 first)."""
    before = F.lag(step).over(by_step(entity, step))
    return F.when(before.isNull(), F.col(step).isin(0, 1)).otherwise(F.col(step) == before + 1)


def last_rows(
    df: DataFrame, entity: str, order: Sequence[Column], k: int, name: str = "recency"
) -> DataFrame:
    """The ``k`` most recent rows of each entity, 1 = latest.

    A row_number filter lets Spark keep k rows per entity on the map side, so an entity
    holding much of the table sends k rows per input partition, not all of them.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def latest_trend(
    df: DataFrame, entity: str, value: str, order: Sequence[Column]
) -> DataFrame:
    """Latest and previous value per entity with the direction of the change.

    Entities with fewer than two values have a null trend.
    """
    two = last_rows(df, entity, order, 2)
    wide = two.groupBy(entity).agg(
        F.max(F.when(F.col("recency") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("recency") == 2, F.col(value))).alias("previous"),
    )
    delta = F.col("latest") - F.col("previous")
    return wide.withColumn("delta", delta).withColumn("trend", trend_class(F.col("delta")))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.col(value) / total)
