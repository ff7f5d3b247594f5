"""Which treatment each column with gaps gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwright.operators.ordering import exact_quantiles

DROP, LISTWISE, INDICATOR, IMPUTE = "drop", "listwise", "indicator", "impute"


@dataclass(frozen=True)
class RouteConfig:
    hard_drop: float = 0.80
    soft_drop: float = 0.50
    listwise_max_rate: float = 0.15
    listwise_min_rows: int = 500
    impute_importance_pct: float = 50.0


def route_columns(
    diagnostics: DataFrame,
    importance: DataFrame | None,
    n_rows: int,
    config: RouteConfig = RouteConfig(),
) -> DataFrame:
    """Adds ``importance`` and ``pathway`` to the diagnostics table.

    ``importance`` has (source, column, importance). Panel columns are never dropped.
    """
    c = config
    if importance is None:
        table = diagnostics.withColumn("importance", F.lit(None).cast("double"))
        low = F.lit(False)
        high = F.lit(True)
    else:
        cuts = exact_quantiles(
            importance, ["importance"], {"q25": 0.25, "q_impute": c.impute_importance_pct / 100}
        ).select(F.struct("q25", "q_impute"))
        table = (
            diagnostics.join(importance, ["source", "column"], "left")
            .withColumn("importance", F.coalesce("importance", F.lit(0.0)))
            .withColumn("_cut", cuts.scalar())
        )
        low = F.col("importance") <= F.col("_cut.q25")
        high = F.col("importance") > F.col("_cut.q_impute")
    rate, static = F.col("missing_rate"), F.col("source") == "static"
    pathway = (
        F.when(static & (rate > c.hard_drop), DROP)
        .when(static & (rate > c.soft_drop) & low, DROP)
        .when(
            (F.col("mechanism") == "MCAR") & (rate < c.listwise_max_rate)
            & (n_rows * (1 - rate) > c.listwise_min_rows),
            LISTWISE,
        )
        .when((F.col("mechanism") == "MAR") & high, IMPUTE)
        .otherwise(INDICATOR)
    )
    return table.withColumn("pathway", pathway).drop("_cut")


def rationale(table: DataFrame, hard_drop: float = 0.80) -> DataFrame:
    """Audit rows: rounded rate and a sentence saying why the pathway was chosen."""
    pct = F.format_string("%.1f%%", F.col("missing_rate") * 100)
    why = (
        F.when(
            F.col("pathway") == DROP,
            F.concat(
                F.lit("Dropped: "), pct,
                F.when(F.col("missing_rate") > hard_drop, " missing, above the hard threshold.")
                .otherwise(" missing and low feature importance."),
            ),
        )
        .when(
            F.col("pathway") == LISTWISE,
            F.concat(F.lit("Rows removed: "), pct, F.lit(" missing, mechanism MCAR, enough rows remain.")),
        )
        .when(
            F.col("pathway") == IMPUTE,
            F.concat(F.lit("Imputed: "), pct, F.lit(" missing, explained by observed columns.")),
        )
        .when(
            F.col("pattern") == "MNAR_dropout",
            F.lit("Indicator and fill: missing rate climbs with the step (dropout)."),
        )
        .otherwise(
            F.concat(F.lit("Indicator and fill: mechanism "), F.col("mechanism"), F.lit(", "), pct,
                     F.lit(" missing."))
        )
    )
    return table.select(
        "source", "column", F.round(F.col("missing_rate") * 100, 2).alias("missing_rate_pct"),
        "mechanism", F.col("pattern").alias("temporal_pattern"), "pathway", why.alias("rationale"),
    )
