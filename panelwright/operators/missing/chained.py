"""Chained-equation imputation with Spark ML regressors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from panelwright.operators.missing.fill import carry_forward, fill_central
from panelwright.session import cut_lineage, fit_rows


def iteration_count(missing_rate: float, low: int = 20, high: int = 100) -> int:
    """Rounds grow with the share of missing information, as a percentage."""
    return max(low, min(high, int(missing_rate * 100)))


def make_regressor(kind: str, seed: int = 42):
    if kind == "linear":
        return LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", regParam=1e-6)
    return RandomForestRegressor(
        featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=10, maxDepth=8,
        featureSubsetStrategy="onethird", subsamplingRate=0.9, seed=seed,
    )


def chained_impute(
    df: DataFrame,
    columns: Sequence[str],
    context: Sequence[str] = (),
    kind: str = "forest",
    max_rounds: int = 20,
    tolerance: float = 1e-3,
    seed: int = 42,
) -> DataFrame:
    """Fills ``columns`` by regressing each on the others, round after round.

    Starts from medians, refits on observed rows only, and leaves observed cells untouched.
    All columns of a round are fitted on the state that the round before left, and one pass
    applies all models: as many fits as columns, none of which repeats another's predictions.
    Each round ends in one reliable checkpoint, so the plan stays as long as one round and
    a lost executor costs one round. Rounds stop early once the imputed cells of a round
    move by less than ``tolerance`` of the column's spread.
    """
    columns = list(columns)
    if not columns:
        return df
    was = {c: f"_was_{c}" for c in columns}
    marked = df.withColumns({was[c]: F.col(c).isNull() for c in columns})
    state = fit_rows(fill_central(marked, columns))
    first = state.agg(
        *[F.count_if(F.col(was[c])).alias(was[c]) for c in columns],
        *[F.stddev_pop(c).alias(c) for c in columns],
    ).first()
    todo = [c for c in columns if first[was[c]] > 0]
    spread = {c: first[c] or 1.0 for c in todo}
    for _ in range(max_rounds if todo else 0):
        nxt = state
        for at, c in enumerate(todo):
            inputs = [*[o for o in columns if o != c], *context]
            assembler = VectorAssembler(inputCols=inputs, outputCol="_x")
            train = assembler.transform(state.filter(~F.col(was[c]))).select("_x", F.col(c).cast("double").alias("_y"))
            model = make_regressor(kind, seed + at).fit(train)
            nxt = model.transform(assembler.transform(nxt)).withColumnRenamed("_p", f"_new_{c}").drop("_x")
        nxt = nxt.withColumns({
            **{f"_old_{c}": F.col(c) for c in todo},
            **{c: F.when(F.col(was[c]), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in todo},
        }).drop(*[f"_new_{c}" for c in todo])
        nxt = cut_lineage(nxt)
        moved = nxt.agg(
            *[
                F.avg(F.when(F.col(was[c]), F.abs(F.col(c) - F.col(f"_old_{c}")))).alias(c)
                for c in todo
            ]
        ).first()
        state = nxt.drop(*[f"_old_{c}" for c in todo])
        if max((moved[c] or 0.0) / spread[c] for c in todo) < tolerance:
            break
    return state.drop(*was.values())


def impute_panel(
    panel: DataFrame, columns: Sequence[str], entity: str, step: str = "step", **options
) -> DataFrame:
    """Past-only fill first, then chained equations with the step as a predictor."""
    carried = carry_forward(panel, columns, entity, step)
    return chained_impute(carried, columns, context=[step], **options)


def legacy_fill(
    static: DataFrame, panel: DataFrame, numeric: Sequence[str], texts: Sequence[str],
    panel_columns: Sequence[str], entity: str, step: str = "step", constants: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Older fill: linear chained equations, constants, modes and past-only fill."""
    constants = constants or {}
    done = chained_impute(static, numeric, kind="linear")
    done = done.fillna({c: v for c, v in constants.items() if c in done.columns})
    done = fill_central(done, [c for c in texts if c not in constants])
    carried = carry_forward(panel, panel_columns, entity, step)
    return done, chained_impute(carried, panel_columns, context=[step], kind="linear")
