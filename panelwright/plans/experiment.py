"""Train, resample, fit, set the threshold, evaluate: candidates side by side, and the choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.operators.evaluate import (
    auc_over_folds, best_threshold, binary_metrics, candidate_score, overfit_warnings, rank_metrics, threshold_table,
)
from panelwright.operators.features import stratified_split
from panelwright.operators.models import template_rows
from panelwright.operators.validation import (
    Figures, Fitted, Recipe, cross_validate, fit_recipe, folded, together, train_figures,
)
from panelwright.session import cut_lineage, fit_rows

FIGURES = (
    "threshold", "cv_auc_mean", "cv_auc_sd", "train_balanced", "val_balanced", "test_balanced", "val_auc", "test_auc",
    "val_recall", "test_recall", "test_min_recall", "test_predicted_rate", "test_actual_rate", "test_mean_positive",
    "test_mean_negative", "test_mcc", "clinical_delta", "high_risk_p",
)


@dataclass(frozen=True)
class Choice:
    """All candidates with their figures, the one chosen, and what it takes to use it."""

    candidates: DataFrame
    name: str
    fitted: Fitted
    threshold: float


def evaluate_candidate(
    rows: DataFrame, dealt: DataFrame, entity: str, label: str, features: Sequence[str], recipe: Recipe,
    templates: Mapping[str, Mapping[str, float]], figures: Mapping[int | None, Figures], seed: int,
) -> tuple[Fitted, dict]:
    """The model fitted on the training split and its figures on all three.

    ``dealt`` are the training rows with their folds; ``figures`` those outside each fold, and of the
    whole training split under None. Folds and final fit run side by side.
    """
    train = rows.filter("split = 'train'")

    def folds():
        scored = cross_validate(dealt, entity, label, features, recipe, fold="fold", seed=seed, figures=figures)
        return auc_over_folds(scored, label, "probability").first()

    def whole():
        return fit_recipe(train, entity, label, features, recipe, seed, figures[None])

    folds, fitted = together(rows.sparkSession, lambda work: work(), [folds, whole], 2)
    scored = cut_lineage(fitted.score(rows).select(entity, label, "split", "probability"))
    held = scored.filter("split = 'validation'")
    limit = best_threshold(threshold_table(held, label, "probability")).first()["threshold"]
    at = {r["split"]: r for r in binary_metrics(scored, label, "probability", limit, ["split"]).collect()}
    auc = {r["split"]: r["roc_auc"] for r in rank_metrics(scored, label, "probability", ["split"], few_groups=True).collect()}
    risk = {}
    if templates:
        risk = {r["template"]: r["probability"] for r in fitted.score(template_rows(train, features, templates)).collect()}
    of = lambda split, name: at[split][name] if split in at else None
    return fitted, {
        "threshold": limit, "cv_auc_mean": folds["auc_mean"], "cv_auc_sd": folds["auc_sd"],
        "train_balanced": of("train", "balanced_accuracy"), "val_balanced": of("validation", "balanced_accuracy"),
        "test_balanced": of("test", "balanced_accuracy"), "val_auc": auc.get("validation"), "test_auc": auc.get("test"),
        "val_recall": of("validation", "recall"), "test_recall": of("test", "recall"),
        "test_min_recall": of("test", "min_class_recall"), "test_predicted_rate": of("test", "predicted_rate"),
        "test_actual_rate": of("test", "actual_rate"), "test_mean_positive": of("test", "mean_score_positive"),
        "test_mean_negative": of("test", "mean_score_negative"), "test_mcc": of("test", "mcc"),
        "clinical_delta": risk.get("high", 0.0) - risk.get("low", 0.0), "high_risk_p": risk.get("high", 0.0),
    }


def choose_model(
    rows: DataFrame, entity: str, label: str, features: Sequence[str], recipes: Sequence[Recipe],
    templates: Mapping[str, Mapping[str, float]] | None = None, k: int = 5, seed: int = 42, out: str | None = None,
    parallel: int = 2,
) -> Choice:
    """Fits every recipe on the training entities and chooses by candidate score.

    Folds and resampling stay inside the training split; folds and the figures that filling and
    scaling learn are the same for every recipe and found once. The threshold comes from the
    validation split and the test split decides nothing. ``templates`` may hold a ``low`` and a
    ``high`` risk row (feature values; others at their mean). With ``out`` the candidate table
    is written there. Equal scores go by name.
    """
    labelled = rows.filter(F.col(label).isNotNull())
    split = stratified_split(labelled, entity, label, seed=seed).select(entity, "split")
    coded = fit_rows(labelled.select(entity, label, *features).join(split, entity))
    spark, train = coded.sparkSession, coded.filter("split = 'train'")
    dealt = folded(train, entity, label, features, k, seed)
    held = [*sorted(r[0] for r in dealt.select("fold").distinct().collect()), None]
    seen = together(spark, lambda at: train_figures(
        train if at is None else dealt.filter(F.col("fold") != at), features), held, 4)
    figures = dict(zip(held, seen))
    made = together(
        spark, lambda r: evaluate_candidate(coded, dealt, entity, label, features, r, templates or {}, figures, seed), recipes, parallel)
    lines = [(r.name, *[None if f[c] is None else float(f[c]) for c in FIGURES]) for r, (_, f) in zip(recipes, made)]
    table = coded.sparkSession.createDataFrame(lines, "candidate string, " + ", ".join(f"{c} double" for c in FIGURES))
    first = Window.orderBy(F.desc_nulls_last("candidate_score"), "candidate")  # one row per recipe
    table = overfit_warnings(candidate_score(table)).withColumn("chosen", F.row_number().over(first) == 1)
    if out:
        table.write.mode("overwrite").parquet(out)
        table = coded.sparkSession.read.parquet(out)
    best = table.filter("chosen").first()
    fitted = next(m for r, (m, _) in zip(recipes, made) if r.name == best["candidate"])
    return Choice(table, best["candidate"], fitted, best["threshold"])
