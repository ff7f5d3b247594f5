"""From a cleaned (static, panel) pair to one leakage-safe training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.categories import success_label
from panelwright.functions.dates import epoch_day
from panelwright.operators import stats as S
from panelwright.operators.features import (
    TrainFit, drop_policy, observed_labels, split_panel, step_features, stratified_split,
)
from panelwright.session import cut_lineage


@dataclass
class ModelInputs:
    table: DataFrame
    features: list[str]
    split: DataFrame


def prepare_model_inputs(
    static: DataFrame,
    panel: DataFrame,
    entity: str,
    metrics: Sequence[str],
    outcome: str = "outcome",
    train: float = 0.7,
    validation: float = 0.2,
    seed: int = 42,
    step: str = "step",
) -> ModelInputs:
    """One row per (entity, step) with label, split and scaled features.

    The split is by entity; fills, vocabularies and scales are learnt from training
    entities only. Flags and one-hot columns stay 0/1.
    """
    labelled = observed_labels(static).withColumn("label", success_label(F.col(outcome)))
    labelled = labelled.filter(F.col("label").isNotNull()).drop(outcome)
    split = cut_lineage(stratified_split(labelled, entity, "label", train, validation, seed))
    usable = drop_policy(labelled)
    days = {
        f.name: epoch_day(F.col(f.name))
        for f in usable.schema if f.dataType.typeName() in ("date", "timestamp")
    }
    usable = usable.withColumns(days) if days else usable
    columns = [c for c in usable.columns if c not in (entity, "label")]
    in_train = split.filter("split = 'train'").select(entity)
    static_fit = TrainFit.learn(usable.join(in_train, entity, "left_semi"), columns)
    known = panel.join(split.select(entity), entity, "left_semi")
    panel_fit = TrainFit.learn(split_panel(panel, split, entity, "train"), metrics, entity, step)
    filled = panel_fit.apply(known)
    inputs = [c for c in filled.columns if c not in (entity, step)]
    per_step = step_features(filled, inputs, entity, step=step)
    table = (
        per_step.join(static_fit.apply(usable), entity)
        .join(split.select(entity, "split"), entity)
    )
    features = [c for c in table.columns if c not in (entity, step, "label", "split")]
    prefixes = tuple(f"{c}_" for c in [*static_fit.vocabularies, *static_fit.encoders])
    scaled = [c for c in features if not S.is_binary_name(c, prefixes)]
    table = cut_lineage(table)
    fit = S.scale_fit(table.filter("split = 'train'"), scaled)
    return ModelInputs(S.standardize(table, fit, scaled), features, split)
