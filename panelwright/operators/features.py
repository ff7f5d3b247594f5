"""Leakage-safe model inputs: step features, entity split, train-only fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, functions as F

from panelwright import fixed_values as V
from panelwright.operators.missing.fill import carry_forward, numeric_columns
from panelwright.operators.ordering import digest_order, medians, modes, row_numbers
from panelwright.operators.panel import one_hot, vocabulary
from panelwright.operators.profile import one_pass
from panelwright.operators.windows import prefix_features


#: Distinct values up to which a text column becomes one indicator column per value.
WIDE = 1000


def drop_policy(df: DataFrame, extra: Sequence[str] = (), static_removed: bool = True) -> DataFrame:
    """Without identifiers, outcome-time and late fields; the policy is a list of names."""
    names = {*V.LEAKAGE_COLUMNS, *extra}
    if static_removed:
        names |= set(V.REMOVED_STATIC_COLUMNS)
        names |= {f"is_missing_{c}" for c in V.REMOVED_STATIC_COLUMNS}
    return df.drop(*names)


def observed_labels(df: DataFrame, flag: str = "is_missing_outcome") -> DataFrame:
    """Rows whose outcome was observed rather than filled in."""
    if flag not in df.columns:
        return df
    return df.filter(F.coalesce(F.col(flag).try_cast("int"), F.lit(1)) == 0)


def step_features(
    panel: DataFrame,
    metrics: Sequence[str],
    entity: str,
    steps: Sequence[int] = V.PANEL_STEPS,
    step: str = "step",
) -> DataFrame:
    """One row per (entity, step) that knows the history up to that step and nothing later.

    ``M{i}_{metric}`` is zero for i beyond the row's step. Names are stable across steps,
    so rows of different steps form one training table.
    """
    return prefix_features(panel, metrics, entity, step, raw_steps=steps)


def features_at_step(
    panel: DataFrame, static: DataFrame, metrics: Sequence[str], entity: str, at: int,
    step: str = "step",
) -> DataFrame:
    """Static columns plus everything known at step ``at``, one row per entity."""
    known = panel.filter(F.col(step) <= at)
    steps = [s for s in V.PANEL_STEPS if s <= at]
    row = step_features(known, metrics, entity, steps, step).filter(F.col(step) == at).drop(step)
    return static.join(row, entity, "left")


def stratified_split(
    df: DataFrame,
    entity: str,
    label: str,
    train: float = 0.7,
    validation: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """(entity, label, split): exact per-class proportions in a reproducible random order.

    The order is an MD5 digest, ranked in buckets of it, so a class holding most of the table is
    spread over all tasks.
    """
    place, bucket = digest_order(entity, seed=seed)
    ordered = df.select(entity, label, place.alias("_h"), bucket.alias("_b"))
    ranked = row_numbers(ordered, ["_h", entity], "_rank", [label], bucket=F.col("_b"), size="_n")
    edge = F.round(F.col("_n") * train)
    edge2 = F.round(F.col("_n") * (train + validation))
    split = (
        F.when(F.col("_rank") <= edge, "train")
        .when(F.col("_rank") <= edge2, "validation")
        .otherwise("test")
    )
    return ranked.select(entity, label, split.alias("split"))


def stratified_folds(df: DataFrame, entity: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(entity, label, fold): per class, the same reproducible order dealt to ``k`` folds in turn."""
    place, bucket = digest_order(entity, seed=seed)
    ordered = df.select(entity, label, place.alias("_h"), bucket.alias("_b"))
    ranked = row_numbers(ordered, ["_h", entity], "_rank", [label], bucket=F.col("_b"))
    return ranked.select(entity, label, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def split_panel(panel: DataFrame, split: DataFrame, entity: str, name: str) -> DataFrame:
    """Panel rows of the entities in one split."""
    return panel.join(split.filter(F.col("split") == name).select(entity), entity, "left_semi")


def dense_ids(df: DataFrame, key: str, name: str = "no", start: int = 0) -> DataFrame:
    """Consecutive row numbers in the order of a unique numeric or date key."""
    numbered = row_numbers(df, [key], name)
    return numbered.withColumn(name, F.col(name) - 1 + start)


@dataclass
class TrainFit:
    """Fill values, indicators and vocabularies learnt from training rows only.

    Holds one value per column: what a fitted model object holds, not data. A text column of
    over ``WIDE`` values becomes one sparse vector column ``<column>_onehot``, in alphabetical
    order, instead of a column per value; unseen values are all zeros in both.
    """

    fills: dict = field(default_factory=dict)
    indicators: list = field(default_factory=list)
    vocabularies: dict = field(default_factory=dict)
    encoders: dict = field(default_factory=dict)
    entity: str | None = None
    step: str | None = None

    @classmethod
    def learn(
        cls, train: DataFrame, columns: Sequence[str], entity: str | None = None,
        step: str | None = None, unknown_above: float = 0.90,
    ) -> "TrainFit":
        """With ``entity`` and ``step`` the rows are a panel: fills are learnt after past-only fill."""
        fit = cls(entity=entity, step=step)
        rates = {
            r["column"]: r["rate"]
            for r in one_pass(train, columns, {"rate": lambda c: F.avg(c.isNull().cast("double"))}).collect()
        }
        fit.indicators = [c for c in columns if rates[c] > 0]
        numbers = numeric_columns(train, columns)
        texts = [c for c in columns if c not in numbers]
        source = carry_forward(train, columns, entity, step) if step else train
        if numbers:
            row = medians(source, numbers).first()
            fit.fills.update({c: 0.0 if row is None or row[c] is None else row[c] for c in numbers})
        if texts:
            row = modes(train, texts).first()
            for c in texts:
                common = None if row is None else row[c]
                fit.fills[c] = "Unknown" if common is None or rates[c] > unknown_above else common
                if train.select(c).distinct().limit(WIDE + 2).filter(F.col(c).isNotNull()).count() > WIDE:
                    codes = StringIndexer(
                        inputCol=c, outputCol=f"{c}__code", stringOrderType="alphabetAsc", handleInvalid="keep")
                    flags = OneHotEncoder(inputCol=f"{c}__code", outputCol=f"{c}_onehot")
                    fit.encoders[c] = Pipeline(stages=[codes, flags]).fit(train.select(c).fillna({c: fit.fills[c]}))
                    continue
                seen = vocabulary(train, c)
                fit.vocabularies[c] = sorted({*seen, fit.fills[c]} if rates[c] > 0 else seen)
        return fit

    def apply(self, df: DataFrame) -> DataFrame:
        """Indicators for columns with gaps in training, fills, then one-hot text columns."""
        out = df.withColumns(
            {f"{c}__missing": F.col(c).isNull().cast("double") for c in self.indicators}
        ) if self.indicators else df
        if self.step:
            out = carry_forward(out, list(self.fills), self.entity, self.step)
        out = out.fillna(self.fills)
        for c, values in self.vocabularies.items():
            out = one_hot(out, c, values)
        for c, encoder in self.encoders.items():
            out = encoder.transform(out).drop(c, f"{c}__code")
        return out
