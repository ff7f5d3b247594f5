"""Other live views: risk alerts and daily intake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwright.functions.numeric import trend_class

ALERT = "entity_id long, latest double, previous double, timestamp long"
ALERT_STATE = "latest double, latest_at long, latest_no long, previous double, previous_at long, previous_no long"
ROW = "entity_id long, failure_probability double, timestamp long, no long"


def _newest_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most two rows per entity leave an Arrow batch: older ones cannot show."""
    for batch in batches:
        ordered = batch.sort_values(["timestamp", "no"], kind="stable")
        yield ordered.groupby("entity_id", sort=False).tail(2)


def _follow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = []  # (timestamp, number, risk), oldest first
    if state.exists:
        latest, latest_at, latest_no, previous, previous_at, previous_no = state.get
        known = ([(previous_at, previous_no, previous)] if previous_at >= 0 else []) + [(latest_at, latest_no, latest)]
    for batch in batches:
        rows = zip(batch["timestamp"].astype(int), batch["no"].astype(int), batch["failure_probability"].astype(float))
        known = sorted([*known, *rows], key=lambda row: row[:2])[-2:]
    at, no, latest = known[-1]
    previous_at, previous_no, previous = known[-2] if len(known) > 1 else (-1, -1, 0.0)
    state.update((latest, int(at), int(no), previous, int(previous_at), int(previous_no)))
    yield pd.DataFrame(
        {
            "entity_id": [key[0]],
            "latest": [latest],
            "previous": [previous if previous_at >= 0 else None],
            "timestamp": [int(at)],
        }
    ).astype({"previous": "float64"})


def risk_alerts(stream: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest and previous risk per entity with the trend, re-emitted when rows arrive.

    Late rows count by their timestamp, not by their arrival; of equal timestamps the greater
    ``tie`` (an integer column, such as the row's id) is the later one.
    """
    rows = stream.selectExpr(
        "cast(entity_id as long) entity_id",
        "cast(failure_probability as double) failure_probability",
        "cast(timestamp as long) timestamp",
        f"cast({f'`{tie}`' if tie else 0} as long) no",
    ).mapInPandas(_newest_two, ROW)
    followed = rows.groupBy("entity_id").applyInPandasWithState(
        _follow, ALERT, ALERT_STATE, "update", "NoTimeout"
    )
    return followed.withColumn("trend", trend_class(F.col("latest") - F.col("previous")))


def daily_intake(stream: DataFrame, ts: str, event_id: str, late: str = "2 days") -> DataFrame:
    """Events per day and type, each event id counted once, late rows up to ``late``.

    Zone-less timestamps are cast first: only zoned ones carry a watermark.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    unique = timed.dropDuplicatesWithinWatermark([event_id])
    return unique.groupBy(F.window(ts, "1 day").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events")
    ).select(F.col("day.start").alias("day"), "event_type", "events")
