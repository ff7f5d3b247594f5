"""From explanation cases to scores, summary and comparison with an earlier run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwright.operators import explain as X
from panelwright.sources.cases import attribution_rows


@dataclass
class ExplanationRun:
    scored: DataFrame
    summary: DataFrame
    deltas: DataFrame | None


def evaluate_cases(cases: DataFrame, baseline: DataFrame | None = None, top_k: int = 5) -> ExplanationRun:
    """Scores every case; with a ``baseline`` summary also the change of each summary metric."""
    truth = X.truth_rows(attribution_rows(cases), top_k)
    claimed = X.claims(cases, "explanation", "case_id").withColumn(
        "feature", X.canonical_name(F.col("feature"))
    )
    scored = X.score_cases(truth, claimed, cases)
    summary = X.run_summary(scored)
    deltas = None
    if baseline is not None:
        deltas = X.compare_runs(_as_rows(baseline), _as_rows(summary))
    return ExplanationRun(scored, summary, deltas)


def _as_rows(summary: DataFrame) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in summary.columns
    ]
    return summary.select(F.inline(F.array(*pairs)))
