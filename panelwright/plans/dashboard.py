"""Operational roll-ups behind a monitoring page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as V
from panelwright.functions.numeric import risk_band


def risk_rollup(latest: DataFrame) -> DataFrame:
    """Entities, mean latest risk and trend counts per risk band of a latest/previous table."""
    band = risk_band(F.col("latest"), V.DASHBOARD_RISK_CUTS, ("HIGH", "MED", "LOW"))
    delta = F.col("latest") - F.col("previous")
    return latest.groupBy(band.alias("risk")).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("latest").alias("mean_risk"),
        F.count_if(delta < -V.TREND_DELTA).alias("improving"),
        F.count_if(delta > V.TREND_DELTA).alias("worsening"),
        F.count_if(F.col("previous").isNull()).alias("without_trend"),
    )


def due_checkin(start: Column, records: Column, as_of: Column, course_records: int = 13) -> Column:
    """Fewer records than 30-day months elapsed since the start, within the course length."""
    months = F.floor(F.datediff(as_of, start) / 30)
    return F.coalesce(
        (records < course_records) & (months >= 1) & (records < months), F.lit(False)
    )


def delay_status(mean_days: Column) -> Column:
    return (
        F.when(mean_days <= 3, "good").when(mean_days <= 7, "moderate").when(mean_days.isNotNull(), "poor")
    )


def regimen_rollup(entities: DataFrame, regimen: str = "regimen") -> DataFrame:
    """Counts, mean latest risk and trend counts per regimen; no regimen is 'unassigned'."""
    delta = F.col("latest") - F.col("previous")
    return entities.groupBy(F.coalesce(regimen, F.lit("unassigned")).alias("regimen")).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("latest").alias("mean_risk"),
        F.count_if(delta < -V.TREND_DELTA).alias("improving"),
        F.count_if(delta > V.TREND_DELTA).alias("worsening"),
    )


AGE_EDGES = ((17, "0-17"), (34, "18-34"), (49, "35-49"), (64, "50-64"))


def age_band(age: Column) -> Column:
    out = F.when(age.isNull(), None)
    for top, name in AGE_EDGES:
        out = out.when(age <= top, name)
    return out.otherwise("65+")


def population_rollup(entities: DataFrame, records: DataFrame, entity: str) -> DataFrame:
    """Totals, and the same figures per risk band, sex, age band and regimen, in one pass.

    ``entities``: ``sex, age, regimen, latest, previous, days_to_treatment`` per entity;
    ``records``: ``adherence`` per check-in. A row says in ``part`` what it is grouped by and in
    ``value`` the group's name; an entity without the attribute is in a group of its own.
    Records are counted per entity before the roll-up, so they are read once as well.
    """
    mix = records.groupBy(F.col(entity).alias("_entity")).agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("adherence") == a).alias(a) for a in ("full", "partial", "poor")])
    people = entities.join(mix, F.col(entity) == F.col("_entity"), "left").withColumns({
        "risk": risk_band(F.col("latest"), V.DASHBOARD_RISK_CUTS, ("HIGH", "MED", "LOW")), "age_band": age_band(F.col("age")),
        "delta": F.col("latest") - F.col("previous")})
    parts = ["risk", "sex", "age_band", "regimen"]
    people = people.withColumns({c: F.coalesce(c, F.lit("none")) for c in parts})
    trend = F.col("delta").isNotNull()
    up, down = F.col("delta") > V.TREND_DELTA, F.col("delta") < -V.TREND_DELTA
    table = people.groupingSets([[c] for c in parts] + [[]], *parts).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("latest").alias("mean_risk"),
        F.count_if(F.col("regimen") != "none").alias("on_treatment"),
        F.count_if(trend & down).alias("improving"), F.count_if(trend & up).alias("worsening"),
        F.count_if(trend & ~up & ~down).alias("stable"), F.count_if(~trend).alias("without_trend"),
        F.avg("days_to_treatment").alias("mean_days"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "full", "partial", "poor")],
    )
    part = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in parts], F.lit("all"))
    share = F.try_divide(100 * F.col("full"), F.col("records"))
    return table.select(
        part.alias("part"), F.coalesce(*parts, F.lit("all")).alias("value"), "entities", "mean_risk", "on_treatment", "improving",
        "worsening", "stable", "without_trend", "mean_days", delay_status(F.round("mean_days")).alias("delay"), "records", "full",
        "partial", "poor", F.round(share).cast("long").alias("full_pct"))
