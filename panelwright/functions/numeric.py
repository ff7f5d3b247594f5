"""Bounds, bands and small numeric rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as V


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """greatest/least skip nulls, so a missing value is guarded and stays missing."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low).cast("double"))
    if high is not None:
        out = F.least(out, F.lit(high).cast("double"))
    return F.when(c.isNotNull(), out)


def null_out_of_range(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def cut(c: Column, edges: Sequence[float], right: bool, labels: Sequence[str]) -> Column:
    """Half-open bins: ``right`` closes them on the right, otherwise on the left."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (c > low) & (c <= high) if right else (c >= low) & (c < high)
        out = F.when(inside, label).otherwise(out)
    return out


def inclusive_bands(c: Column, bands: Sequence[tuple[float | None, float | None, str]]) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c >= low)
        if high is not None:
            inside = inside & (c <= high)
        out = F.when(inside & c.isNotNull(), label).otherwise(out)
    return out


def adherence_share(taken: Column, missed: Column) -> Column:
    total = taken + missed
    return F.when(total > 0, taken / total)


def adherence_band(share: Column) -> Column:
    return (
        F.when(share >= V.ADHERENCE_FULL, "full")
        .when(share >= V.ADHERENCE_PARTIAL, "partial")
        .otherwise("poor")
    )


def clamp_probability(p: Column, ceiling: float = V.PROBABILITY_CEILING) -> Column:
    return clip(p, 0.0, ceiling)


def risk_band(
    p: Column,
    cuts: tuple[float, float] = V.MODEL_RISK_CUTS,
    labels: tuple[str, str, str] = ("HIGH", "MEDIUM", "LOW"),
) -> Column:
    high, low = cuts
    return F.when(p >= high, labels[0]).when(p >= low, labels[1]).when(p.isNotNull(), labels[2])


def confidence_pct(p: Column) -> Column:
    return F.greatest(p, 1 - p) * 100


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrate(
    logit: Column, platt: tuple[float, float] | None = None, temperature: float = 1.0
) -> Column:
    """Platt scaling when fitted, temperature scaling otherwise."""
    if platt is not None:
        a, b = platt
        return sigmoid(logit * a + b)
    return sigmoid(logit / (temperature if temperature > 1e-6 else 1.0))


def trend_class(delta: Column, threshold: float = V.TREND_DELTA) -> Column:
    return (
        F.when(delta < -threshold, "improving")
        .when(delta > threshold, "worsening")
        .when(delta.isNotNull(), "stable")
    )


def prediction_type(truth: Column, predicted: Column) -> Column:
    return (
        F.when((truth == 1) & (predicted == 1), "true_failure")
        .when((truth == 0) & (predicted == 0), "true_success")
        .when((truth == 1) & (predicted == 0), "false_success")
        .when((truth == 0) & (predicted == 1), "false_failure")
        .otherwise("unknown")
    )
