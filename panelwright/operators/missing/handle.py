"""The diagnostic-first treatment of missing data, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from panelwright.operators.missing import chained, diagnose, fill, route
from panelwright.operators.missing.route import RouteConfig
from panelwright.operators.models import with_class_weights
from panelwright.operators.profile import class_balance
from panelwright.session import fit_rows


@dataclass
class MissingResult:
    static: DataFrame
    panel: DataFrame
    decisions: DataFrame
    mcar: dict
    counts: dict = field(default_factory=dict)
    residual: dict = field(default_factory=dict)


def importance_ranking(
    static: DataFrame,
    panel: DataFrame,
    static_columns: Sequence[str],
    panel_columns: Sequence[str],
    entity: str,
    label: str,
    trees: int = 100,
    seed: int = 42,
    min_rows: int = 10,
    depth: int = 12,
) -> DataFrame | None:
    """(source, column, importance) from a balanced forest on labelled rows.

    Panel columns enter as per-entity means; gaps are median-filled for ranking only.
    None when fewer than ``min_rows`` rows carry a label.
    """
    means = panel.groupBy(entity).agg(
        *[F.avg(c).alias(f"{c}__panel_mean") for c in panel_columns]
    )
    features = [*static_columns, *[f"{c}__panel_mean" for c in panel_columns]]
    flat = (
        static.select(entity, label, *static_columns)
        .join(means, entity, "left")
        .filter(F.col(label).isNotNull())
    )
    ready = fit_rows(fill.fill_central(flat, features))
    facts = class_balance(flat, label).agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")
    ).first()
    if (facts["n"] or 0) < min_rows or facts["k"] < 2:
        return None
    weighted = with_class_weights(ready, label)
    indexed = StringIndexer(inputCol=label, outputCol="_label").fit(weighted).transform(weighted)
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(indexed)
    model = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(vectors)
    rows = [
        ("panel" if at >= len(static_columns) else "static",
         (list(static_columns) + list(panel_columns))[at], float(v))
        for at, v in enumerate(model.featureImportances.toArray())
    ]
    return static.sparkSession.createDataFrame(
        rows, "source string, column string, importance double"
    )


def handle_missing(
    static: DataFrame,
    panel: DataFrame,
    entity: str,
    static_columns: Sequence[str],
    panel_columns: Sequence[str],
    label: str | None = None,
    step: str = "step",
    config: RouteConfig = RouteConfig(),
    imputer: str = "forest",
    max_rounds: int | None = None,
    trees: int = 100,
) -> MissingResult:
    """Diagnose, rank, route, treat (drop, listwise, indicator, impute) and fill what is left.

    Only the decision table (one row per column) reaches the driver: it decides the schema.
    ``max_rounds=None`` lets the missing rate set the number of imputation rounds.
    """
    static_columns, panel_columns = list(static_columns), list(panel_columns)
    features = [c for c in static_columns if c != label]
    numeric = fill.numeric_columns(static, features)
    mcar = diagnose.mcar_test(static, numeric)
    found = diagnose.diagnostics(static, panel, static_columns, panel_columns, numeric, step)
    found = diagnose.classify_mechanism(found, mcar["is_mcar"])
    ranking = (
        importance_ranking(static, panel, numeric, panel_columns, entity, label, trees)
        if label else None
    )
    n_rows = static.count()
    routed = route.route_columns(found, ranking, n_rows, config)
    decisions = route.rationale(routed, config.hard_drop)
    plan = decisions.collect()
    report = static.sparkSession.createDataFrame(plan, decisions.schema)

    rates = [r["missing_rate_pct"] / 100 for r in plan if r["pathway"] == route.IMPUTE]
    max_rounds = max_rounds or chained.iteration_count(max(rates, default=0.0))

    def chosen(source: str, pathway: str) -> list[str]:
        return sorted(r["column"] for r in plan if r["source"] == source and r["pathway"] == pathway)

    static = static.drop(*chosen("static", route.DROP))
    complete_on = chosen("static", route.LISTWISE)
    if complete_on:
        static, panel = fill.listwise(static, panel, complete_on, entity)
    marks = chosen("static", route.INDICATOR)
    if marks:
        static = fill.indicator_fill_static(static, marks)
    marks = chosen("panel", route.INDICATOR)
    if marks:
        panel = fill.indicator_fill_panel(panel, marks, entity, step)
    gaps = fill.numeric_columns(static, chosen("static", route.IMPUTE))
    if gaps:
        context = [c for c in numeric if c in static.columns and c not in gaps]
        static = fill.fill_central(static, context) if context else static
        static = chained.chained_impute(static, gaps, context, imputer, max_rounds)
    gaps = fill.numeric_columns(panel, chosen("panel", route.IMPUTE))
    if gaps:
        panel = chained.impute_panel(panel, gaps, entity, step, kind=imputer, max_rounds=max_rounds)
    counts: dict[str, int] = {}
    for r in plan:
        counts[r["pathway"]] = counts.get(r["pathway"], 0) + 1
    left = {}
    for name, frame, keys in (("static", static, [entity]), ("panel", panel, [entity, step])):
        left[name] = {r["column"]: r["missing"] for r in fill.residual_gaps(frame, keys).collect()}
    if left["static"]:
        static = fill.safety_fill(static, [entity], list(left["static"]))
    if left["panel"]:
        panel = fill.safety_fill(panel, [entity, step], list(left["panel"]))
    return MissingResult(
        fill.clip_static(static), fill.clip_panel(panel, entity, step), report, mcar, counts, left
    )


def null_cells(df: DataFrame) -> int:
    cells = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("long"))
    return df.agg(cells).first()[0]
