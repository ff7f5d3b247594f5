"""Missing-data queries over customers and their order panel."""

from itertools import combinations

from pyspark.sql import functions as F

from panelwright.catalog.inputs import (
    CUSTOMER_STATIC, EVENT_PANEL, ORDER_METRICS, ORDER_PANEL, STATIC_NUMBERS, correlation_p_sql,
    customer_static, event_panel, order_panel, r6,
)
from panelwright.catalog.registry import query
from panelwright.operators.missing import chained, diagnose, fill, handle, route

_N = STATIC_NUMBERS
_PATTERN = " || ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in _N)
_MEANS = ", ".join(f"avg({c}) AS mu_{c}, GREATEST(coalesce(var_samp({c}), 1e-10), 1e-10) AS v_{c}" for c in _N)
_GROUP = ", ".join(f"avg({c}) AS {c}" for c in _N)
_D2 = " + ".join(f"coalesce(pow({c} - mu_{c}, 2) / v_{c}, 0)" for c in _N)
_SEEN = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _N)
_GAPS = " + ".join(f"CAST(count({c}) BETWEEN 1 AND count(*) - 1 AS INTEGER)" for c in _N)

_MCAR = f"""
g AS (SELECT {_PATTERN} AS pattern, count(*) AS n_k, {_GROUP} FROM static GROUP BY 1),
t AS (SELECT {_MEANS}, {_GAPS} AS gaps FROM static),
d AS (SELECT n_k * ({_D2}) AS d2, {_SEEN} AS seen, gaps, n_k FROM g, t)"""


@query("M2", sql=f"""
WITH {CUSTOMER_STATIC}, {_MCAR}
SELECT round(sum(d2), 3) AS chi2, CAST(sum(seen) - max(gaps) AS BIGINT) AS df, count(*) AS n_patterns,
       CAST({len(_N)} AS INTEGER) AS n_columns
FROM d WHERE n_k >= 2 AND seen > 0""")
def mcar_test(spark, folder):
    return diagnose.mcar_statistic(customer_static(spark, folder), _N).withColumn("chi2", r6("chi2", 3))


@query("M3", "T-8", sql=f"""
WITH {EVENT_PANEL}, long AS (
  SELECT step, unnest(['doses', 'reading', 'weight']) AS "column",
         unnest([doses IS NULL, reading IS NULL, weight IS NULL]) AS gap FROM panel),
rates AS (SELECT "column", step, avg(CASE WHEN gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM long GROUP BY 1, 2),
r AS (SELECT "column", rank() OVER (PARTITION BY "column" ORDER BY step) AS x,
        rank() OVER (PARTITION BY "column" ORDER BY rate) + (count(*) OVER (PARTITION BY "column", rate) - 1) / 2.0::DOUBLE AS y FROM rates)
SELECT "column", round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def dropout_correlation(spark, folder):
    from panelwright.operators.profile import step_missing_rate
    from panelwright.operators.stats import group_spearman

    rates = step_missing_rate(event_panel(spark, folder), ["doses", "reading", "weight"])
    return group_spearman(rates, "step", "missing_rate", "column").withColumn("rho", r6("rho"))


# With thirteen steps a rank correlation above 0.6 is always significant at 0.05.
_RHO = """
rates AS (SELECT "column", step, avg(CASE WHEN gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM long GROUP BY 1, 2),
r AS (SELECT "column", rank() OVER (PARTITION BY "column" ORDER BY step) AS x,
        rank() OVER (PARTITION BY "column" ORDER BY rate) + (count(*) OVER (PARTITION BY "column", rate) - 1) / 2.0::DOUBLE AS y FROM rates),
rho AS (SELECT "column", CASE WHEN corr(x, y) > 0.6 THEN 'MNAR_dropout' ELSE 'random' END AS pattern FROM r GROUP BY 1)"""


@query("M3", sql=f"""
WITH {EVENT_PANEL}, long AS (
  SELECT step, unnest(['doses', 'reading', 'weight']) AS "column",
         unnest([doses IS NULL, reading IS NULL, weight IS NULL]) AS gap FROM panel), {_RHO}
SELECT * FROM rho""")
def dropout_pattern(spark, folder):
    table = diagnose.dropout_pattern(event_panel(spark, folder), ["doses", "reading", "weight"])
    return table.select("column", "pattern")


@query("M3", sql=f"""
WITH {EVENT_PANEL}, long AS (
  SELECT step, unnest(['doses', 'reading', 'weight']) AS "column",
         unnest([doses IS NULL, reading IS NULL, weight IS NULL]) AS gap FROM panel), {_RHO},
c AS (SELECT "column", corr(x, y) AS r, count(*) AS n FROM r GROUP BY 1), tails AS ({correlation_p_sql("c", '"column"')})
SELECT "column", CASE WHEN NOT isnan(r) THEN round(r, 6) END AS rho, p AS p_value,
       CASE WHEN n < 3 THEN 'N/A' WHEN r > 0.6 AND p < 0.05 THEN 'MNAR_dropout' ELSE 'random' END AS pattern
FROM c LEFT JOIN tails USING ("column")""")
def dropout_significance(spark, folder):
    table = diagnose.dropout_pattern(event_panel(spark, folder), ["doses", "reading", "weight"])
    return table.withColumns({"rho": r6("rho"), "p_value": r6("p_value")})


_PREDICTORS = [c for c in _N if c != "rare"]
_FILLED = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM static)) AS f_{c}" for c in _PREDICTORS)
_CORRS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, abs(corr(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, f_{p})) AS r, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS gaps, count({p}) > count(*) / 2 AS ok FROM f"
    for c in _N for p in _PREDICTORS if p != c
)


@query("M4", "T-8", sql=f"""
WITH {CUSTOMER_STATIC}, f AS (SELECT *, {_FILLED} FROM static), c AS ({_CORRS})
SELECT col AS "column", round(coalesce(max(CASE WHEN ok AND NOT isnan(r) THEN r END), 0), 4) AS max_abs_corr
FROM c WHERE gaps > 0 GROUP BY 1""")
def missing_corr(spark, folder):
    table = diagnose.missingness_correlation(customer_static(spark, folder), _N)
    return table.select("column", "max_abs_corr")


def _diagnosed(spark, folder, is_mcar=False):
    static, panel = customer_static(spark, folder), order_panel(spark, folder)
    found = diagnose.diagnostics(
        static, panel, [*_N, "segment", "outcome"], ORDER_METRICS, list(_N)
    )
    return diagnose.classify_mechanism(found, is_mcar=is_mcar)


_S = (*_N, "segment", "outcome")
_MECHANISM = f"""
{CUSTOMER_STATIC}, {ORDER_PANEL}, f AS (SELECT *, {_FILLED} FROM static), c AS ({_CORRS}),
links AS (SELECT col, round(coalesce(max(CASE WHEN ok AND NOT isnan(r) THEN r END), 0), 4) AS max_abs_corr FROM c WHERE gaps > 0 GROUP BY 1),
long AS (SELECT step, unnest([{", ".join(f"'{m}'" for m in ORDER_METRICS)}]) AS "column",
                unnest([{", ".join(f"{m} IS NULL" for m in ORDER_METRICS)}]) AS gap FROM order_panel), {_RHO},
flat AS (SELECT unnest([{", ".join(f"'{m}'" for m in _S)}]) AS "column", unnest([{", ".join(f"{m} IS NULL" for m in _S)}]) AS gap FROM static),
found AS (
  SELECT 'static' AS source, "column", avg(CAST(gap AS INTEGER)) AS missing_rate, 'N/A' AS pattern, max(max_abs_corr) AS max_abs_corr
  FROM flat LEFT JOIN links ON col = "column" GROUP BY 2 HAVING count(*) FILTER (WHERE gap) > 0
  UNION ALL
  SELECT 'panel', l."column", avg(CAST(gap AS INTEGER)), max(pattern), NULL FROM long l JOIN rho ON rho."column" = l."column"
  GROUP BY 2 HAVING count(*) FILTER (WHERE gap) > 0),
judged AS (SELECT *, CASE WHEN pattern = 'MNAR_dropout' THEN 'MNAR' WHEN max_abs_corr > 0.3 THEN 'MAR' ELSE 'MNAR' END AS mechanism FROM found)"""


@query("M5", sql=f"""
WITH {_MECHANISM}
SELECT source, "column", round(missing_rate, 6) AS missing_rate, pattern, max_abs_corr, mechanism FROM judged""")
def mechanism(spark, folder):
    return _diagnosed(spark, folder).withColumn("missing_rate", r6("missing_rate"))


@query("M7", "M18", "S11", sql=f"""
WITH {_MECHANISM}, routed AS (
  SELECT *, CASE WHEN source = 'static' AND missing_rate > 0.8 THEN 'drop' WHEN mechanism = 'MAR' THEN 'impute' ELSE 'indicator' END AS pathway,
         printf('%.1f%%', missing_rate * 100) AS pct FROM judged)
SELECT source, "column", round(missing_rate * 100, 2) AS missing_rate_pct, mechanism, pattern AS temporal_pattern, pathway,
       CASE WHEN pathway = 'drop' THEN 'Dropped: ' || pct || ' missing, above the hard threshold.'
            WHEN pathway = 'impute' THEN 'Imputed: ' || pct || ' missing, explained by observed columns.'
            WHEN pattern = 'MNAR_dropout' THEN 'Indicator and fill: missing rate climbs with the step (dropout).'
            ELSE 'Indicator and fill: mechanism ' || mechanism || ', ' || pct || ' missing.' END AS rationale FROM routed""")
def route_columns(spark, folder):
    n = customer_static(spark, folder).count()
    return route.rationale(route.route_columns(_diagnosed(spark, folder), None, n))


_OBSERVED = " UNION ALL ".join(
    [f"SELECT 'static' AS source, '{c}' AS \"column\", count({c}) / count(*) AS importance FROM static" for c in _N]
    + [f"SELECT 'panel', '{c}', count({c}) / count(*) FROM order_panel" for c in ORDER_METRICS]
)


@query("M7", "M18", sql=f"""
WITH {_MECHANISM.replace("ELSE 'MNAR' END AS mechanism", "ELSE 'MCAR' END AS mechanism")}, weights AS ({_OBSERVED}),
cuts AS (SELECT quantile_cont(importance, 0.25) AS low, quantile_cont(importance, 0.5) AS high FROM weights),
weighed AS (SELECT j.*, coalesce(w.importance, 0) AS importance, low, high, (SELECT count(*) FROM static) * (1 - missing_rate) AS rest
            FROM judged j LEFT JOIN weights w ON w.source = j.source AND w."column" = j."column" CROSS JOIN cuts),
routed AS (
  SELECT *, printf('%.1f%%', missing_rate * 100) AS pct,
         CASE WHEN source = 'static' AND (missing_rate > 0.8 OR missing_rate > 0.5 AND importance <= low) THEN 'drop'
              WHEN mechanism = 'MCAR' AND missing_rate < 0.15 AND rest > 100 THEN 'listwise'
              WHEN mechanism = 'MAR' AND importance > high THEN 'impute' ELSE 'indicator' END AS pathway FROM weighed)
SELECT source, "column", round(missing_rate * 100, 2) AS missing_rate_pct, mechanism, pattern AS temporal_pattern, pathway,
       CASE WHEN pathway = 'drop' AND missing_rate > 0.8 THEN 'Dropped: ' || pct || ' missing, above the hard threshold.'
            WHEN pathway = 'drop' THEN 'Dropped: ' || pct || ' missing and low feature importance.'
            WHEN pathway = 'listwise' THEN 'Rows removed: ' || pct || ' missing, mechanism MCAR, enough rows remain.'
            WHEN pathway = 'impute' THEN 'Imputed: ' || pct || ' missing, explained by observed columns.'
            WHEN pattern = 'MNAR_dropout' THEN 'Indicator and fill: missing rate climbs with the step (dropout).'
            ELSE 'Indicator and fill: mechanism ' || mechanism || ', ' || pct || ' missing.' END AS rationale FROM routed""")
def route_by_importance(spark, folder):
    """All five treatments: gaps count as random where nothing explains them, and observed share is the importance."""
    static, panel = customer_static(spark, folder), order_panel(spark, folder)
    share = lambda df, source, columns: df.agg(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(c).alias("column"), (F.count(c) / F.count(F.lit(1))).alias("importance"))
        for c in columns]).alias("w")).select(F.inline("w"))
    weights = share(static, "static", _N).unionByName(share(panel, "panel", ORDER_METRICS))
    config = route.RouteConfig(listwise_min_rows=100)
    return route.rationale(route.route_columns(_diagnosed(spark, folder, True), weights, static.count(), config))


@query("M6")
def importance_ranking(spark, folder):
    return handle.importance_ranking(
        customer_static(spark, folder), order_panel(spark, folder), list(_N), list(ORDER_METRICS),
        "entity_id", "outcome",
    )


@query("M9", "F4", "J4", sql=f"""
WITH {CUSTOMER_STATIC}, {ORDER_PANEL}
SELECT p.entity_id, p.step, p.n_orders FROM order_panel p
WHERE p.entity_id IN (SELECT entity_id FROM static WHERE segment IS NOT NULL AND balance IS NOT NULL)""")
def listwise_cascade(spark, folder):
    panel = order_panel(spark, folder).select("entity_id", "step", "n_orders")
    return fill.listwise(customer_static(spark, folder), panel, ["segment", "balance"], "entity_id")[1]


@query("M8", "F9", sql=f"""
WITH {CUSTOMER_STATIC}
SELECT entity_id, balance, credit, nation, score, segment, outcome FROM static""")
def drop_sparse_columns(spark, folder):
    from panelwright.operators.profile import missing_by_column

    static = customer_static(spark, folder)
    table = missing_by_column(static, [c for c in static.columns if c != "entity_id"])
    sparse = [r["column"] for r in table.filter("excluded").collect()]
    return static.drop(*sparse)


@query("M11")
def chained_impute(spark, folder):
    static = customer_static(spark, folder).select("entity_id", "balance", "credit", "nation", "score")
    return chained.chained_impute(static, ["balance", "credit", "score"], ["nation"], kind="linear")


@query("M14")
def legacy_fill(spark, folder):
    static = customer_static(spark, folder).select("entity_id", "balance", "credit", "segment")
    panel = order_panel(spark, folder).select("entity_id", "step", "n_orders", "filled")
    done, carried = chained.legacy_fill(
        static, panel, ["balance", "credit"], ["segment"], ["n_orders", "filled"], "entity_id"
    )
    return done.join(carried, "entity_id", "left")


@query("M15", "X4", "P24")
def encoded_impute(spark, folder):
    from panelwright.plans.registry import impute_encoded

    return impute_encoded(
        customer_static(spark, folder).select("entity_id", "balance", "nation", "segment"),
        numeric=["balance", "nation"], texts=["segment"], bounds={"balance": (0, 10000)},
    )


@query("M17", "M12", "M13", "M18")
def handle_missing(spark, folder):
    result = handle.handle_missing(
        customer_static(spark, folder), order_panel(spark, folder), "entity_id",
        [*_N, "segment", "outcome"], list(ORDER_METRICS), label="outcome", max_rounds=None,
    )
    return result.static.join(result.panel, "entity_id", "left")


_TRAIN = "outcome IN ('Cured', 'Died')"


@query("M16", sql=f"""
WITH {CUSTOMER_STATIC}, tr AS (SELECT * FROM static WHERE {_TRAIN}),
m AS (SELECT (SELECT quantile_cont(balance, 0.5) FROM tr) AS mb, (SELECT quantile_cont(credit, 0.5) FROM tr) AS mc,
      (SELECT count(*) > 0 FROM tr WHERE balance IS NULL) AS gb, (SELECT count(*) > 0 FROM tr WHERE credit IS NULL) AS gc)
SELECT entity_id, round(coalesce(balance, mb), 6) AS balance, round(coalesce(credit, mc), 6) AS credit,
       CASE WHEN gb AND balance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS balance__missing
FROM static, m""")
def train_only_fit(spark, folder):
    from panelwright.operators.features import TrainFit

    static = customer_static(spark, folder).select("entity_id", "balance", "credit", "outcome")
    fit = TrainFit.learn(static.filter(F.col("outcome").isin("Cured", "Died")), ["balance", "credit"])
    out = fit.apply(static.drop("outcome"))
    return out.select("entity_id", r6("balance").alias("balance"), r6("credit").alias("credit"), "balance__missing")


@query("T-1", "M4", sql=f"""
WITH {CUSTOMER_STATIC}
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count(*) >= 10 AND NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 6) END AS r, count(*) AS n FROM static WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(_N, 2))}""")
def pearson_pairwise_complete(spark, folder):
    from panelwright.operators.stats import pearson_pairs

    return pearson_pairs(customer_static(spark, folder), list(_N)).withColumn("r", r6("r"))
