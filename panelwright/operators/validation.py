"""Cross-validation in which all that is fitted is fitted inside the fold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.evaluate import auc_over_folds, rank_metrics
from panelwright.operators.features import stratified_folds
from panelwright.operators.models import classifier, score, with_class_weights
from panelwright.operators.ordering import attach, medians
from panelwright.operators.resample import balance, class_sizes
from panelwright.operators.stats import scale_fit
from panelwright.session import cut_lineage, fit_rows


@dataclass(frozen=True)
class Recipe:
    """How a model is made of training rows: fill, scale, optionally rebalance, fit."""

    kind: str
    resample: bool = False
    weighted: bool = True
    options: Mapping[str, object] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.kind}_rebalanced" if self.resample else self.kind


@dataclass(frozen=True)
class Fitted:
    """Training figures per feature and the model; scores rows it has never seen."""

    fill: Mapping[str, float]
    scale: Mapping[str, tuple[float, float]]
    model: Model

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        ready = df.withColumn("_x", array_to_vector(vector(self.fill, self.scale)))
        return score(self.model, ready, name).drop("_x")


def vector(fill: Mapping[str, float], scale: Mapping[str, tuple[float, float]]) -> Column:
    """Filled and scaled features as an array, by training figures alone."""
    return F.array(*[
        (F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - mean) / (sd or 1.0) for c, (mean, sd) in scale.items()
    ])


@dataclass(frozen=True)
class Figures:
    """Median and (mean, deviation) of every feature over some training rows."""

    fill: Mapping[str, float]
    scale: Mapping[str, tuple[float, float]]


def _filled(train: DataFrame, fill: Mapping[str, float], *keys: str) -> DataFrame:
    return train.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in fill.items()])


def train_figures(train: DataFrame, features: Sequence[str]) -> Figures:
    """What filling and scaling learn from ``train``; they hold for every recipe fitted on these rows."""
    middle = medians(train, list(features)).first()
    fill = {c: float(middle[c]) if middle[c] is not None else 0.0 for c in features}
    figures = scale_fit(_filled(train, fill), list(features)).first()
    return Figures(fill, {c: (figures[c]["mean"], figures[c]["sd"]) for c in features})


def fit_recipe(
    train: DataFrame, entity: str, label: str, features: Sequence[str], recipe: Recipe, seed: int = 42,
    figures: Figures | None = None,
) -> Fitted:
    """Medians, means and deviations, resampled rows and classifier from ``train`` alone.

    The driver sees one row of figures; ``figures`` are those of the same rows, if known already.
    Labels are 0 and 1; both must occur.
    """
    known = figures or train_figures(train, features)
    fill, scale = known.fill, known.scale
    filled = _filled(train, fill, entity, label)
    rows = filled.select(entity, F.col(label).cast("int").alias("label"), vector(fill, scale).alias("vec"))
    sizes = class_sizes(rows, "label")
    if len(sizes) < 2:
        raise ValueError(f"the training rows hold only the classes {sorted(sizes)}")
    if recipe.resample:
        minority = min(sizes, key=lambda c: (sizes[c], c))
        rows = fit_rows(balance(cut_lineage(rows), "vec", "label", entity, minority, seed))
    ready = with_class_weights(rows, "label") if recipe.weighted else rows
    ready = ready.withColumn("_x", array_to_vector("vec"))
    return Fitted(fill, scale, classifier(recipe.kind, "label", recipe.weighted, seed, **recipe.options).fit(ready))


def folded(rows: DataFrame, entity: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """(entity, label, fold, features) of the labelled rows, dealt to stratified folds and written once."""
    labelled = rows.filter(F.col(label).isNotNull())
    folds = stratified_folds(labelled, entity, label, k, seed).select(entity, "fold")
    return fit_rows(labelled.drop("fold").join(folds, entity).select(entity, label, "fold", *features))


def cross_validate(
    rows: DataFrame, entity: str, label: str, features: Sequence[str], recipe: Recipe, k: int = 5,
    fold: str | None = None, seed: int = 42, parallel: int = 4, figures: Mapping[int, Figures] | None = None,
) -> DataFrame:
    """(entity, label, fold, probability): every labelled row scored by a model that never saw its fold.

    Folds are stratified by class, or those of the column ``fold``. The matrix is written once
    with its fold number; each fold fits on the others, up to ``parallel`` at a time, as Spark
    jobs of their own. Resampling sees training rows only, so no synthetic row and no neighbour
    of a held-out row leaks into its score. ``figures`` are those of the rows outside each fold, if
    known already.
    """
    if fold is None:
        coded = folded(rows, entity, label, features, k, seed)
    else:
        labelled = rows.filter(F.col(label).isNotNull()).withColumn("fold", F.col(fold).cast("int"))
        coded = fit_rows(labelled.select(entity, label, "fold", *features))
    found = sorted(r[0] for r in coded.select("fold").distinct().collect())

    def one(at: int) -> DataFrame:
        known = (figures or {}).get(at)
        fitted = fit_recipe(coded.filter(F.col("fold") != at), entity, label, features, recipe, seed, known)
        held = fitted.score(coded.filter(F.col("fold") == at))
        return cut_lineage(held.select(entity, label, "fold", "probability"))

    if not found:
        return coded.select(entity, label, "fold", F.lit(None).cast("double").alias("probability"))
    return reduce(DataFrame.unionByName, together(coded.sparkSession, one, found, parallel))


def together(spark, task: Callable, items: Sequence, parallel: int) -> list:
    """``task`` of every item, as Spark jobs side by side; results in the order of ``items``."""
    with ThreadPool(max(1, min(parallel, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), items)


def fold_report(scored: DataFrame, label: str) -> DataFrame:
    """(fold, rows, roc_auc, pr_auc, auc_mean, auc_sd) of out-of-fold scores."""
    sizes = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    ranked = rank_metrics(scored, label, "probability", ["fold"], few_groups=True)
    return attach(sizes.join(ranked, "fold"), auc_over_folds(scored, label, "probability"), "_all").select(
        "fold", "rows", "roc_auc", "pr_auc", F.col("_all.auc_mean").alias("auc_mean"), F.col("_all.auc_sd").alias("auc_sd"))
