"""Association, scaling and outlier queries."""

from itertools import combinations

from pyspark.sql import functions as F

from panelwright.catalog.inputs import CUSTOMER_STATIC, EVENT_PANEL, correlation_p_sql, customer_static, event_panel, r6
from panelwright.catalog.registry import query
from panelwright.operators import stats as S
from panelwright.sources.tables import read_table

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PEARSON = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem"
    for a, b in combinations(_COLS, 2)
)


@query("T-1", sql=_PEARSON)
def pearson_matrix(spark, folder):
    return S.pearson_pairs(read_table(spark, folder, "lineitem"), _COLS).withColumn("r", r6("r"))


_LAGS = f"""
WITH {EVENT_PANEL}, l AS (
  SELECT step, doses AS now, lag(doses) OVER (PARTITION BY entity_id ORDER BY step) AS before FROM panel),
lags AS (
  SELECT step - 1 AS from_step, step AS to_step, count(*) AS n, corr(before, now) AS r FROM l
  WHERE now IS NOT NULL AND before IS NOT NULL GROUP BY step HAVING count(*) >= 5)"""


@query("T-2", "J11", sql=f"{_LAGS} SELECT from_step, to_step, n, round(r, 6) AS r FROM lags")
def lag_correlation(spark, folder):
    table = S.lag_correlation(event_panel(spark, folder), "doses", "entity_id")
    return table.select("from_step", "to_step", "n", r6("r").alias("r"))


@query("T-2", sql=f"""
{_LAGS}, tails AS ({correlation_p_sql("lags", "to_step")})
SELECT from_step, to_step, round(r, 6) AS r, n, p AS p_value, p < 0.05 AS significant FROM lags LEFT JOIN tails USING (to_step)""")
def lag_significance(spark, folder):
    table = S.lag_correlation(event_panel(spark, folder), "doses", "entity_id")
    return table.withColumns({"r": r6("r"), "p_value": r6("p_value")})


@query("T-2", sql=f"""
WITH {EVENT_PANEL}
SELECT a.step AS step_a, b.step AS step_b, round(corr(a.doses, b.doses), 6) AS r,
       count(*) FILTER (WHERE a.doses IS NOT NULL AND b.doses IS NOT NULL) AS n
FROM panel a JOIN panel b ON a.entity_id = b.entity_id AND a.step < b.step GROUP BY 1, 2""")
def step_correlation(spark, folder):
    table = S.step_correlation(event_panel(spark, folder), "doses", "entity_id", range(13))
    return table.withColumn("r", r6("r"))


def _cramers_sql(source, pairs, yates):
    parts = []
    for a, b in pairs:
        parts.append(f"""
SELECT '{a}' AS a, '{b}' AS b, round(sqrt(chi / (n * (LEAST(ka, kb) - 1))), 6) AS v, n FROM (
  WITH x AS (SELECT {a} AS va, {b} AS vb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
  ra AS (SELECT va, count(*) AS r FROM x GROUP BY 1), cb AS (SELECT vb, count(*) AS c FROM x GROUP BY 1),
  o AS (SELECT va, vb, count(*) AS o FROM x GROUP BY 1, 2), t AS (SELECT count(*) AS n FROM x),
  k AS (SELECT (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM cb) AS kb)
  SELECT sum(pow(GREATEST(abs(coalesce(o, 0) - r * c / n::DOUBLE)
             - CASE WHEN {str(yates).lower()} AND ka = 2 AND kb = 2 THEN 0.5 ELSE 0 END, 0), 2) / (r * c / n::DOUBLE)) AS chi,
         max(n) AS n, max(ka) AS ka, max(kb) AS kb
  FROM ra CROSS JOIN cb CROSS JOIN t CROSS JOIN k LEFT JOIN o ON o.va = ra.va AND o.vb = cb.vb)""")
    return " UNION ALL ".join(parts)


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("T-3", sql=_cramers_sql("lineitem", list(combinations(_CATS, 2)), True))
def cramers_v(spark, folder):
    return S.cramers_v(read_table(spark, folder, "lineitem"), _CATS).withColumn("v", r6("v"))


@query("T-3", sql=f"""
WITH c AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE 'n' END AS f,
                  CASE WHEN o_orderpriority < '3' THEN 'y' ELSE 'n' END AS u FROM orders)
{_cramers_sql("c", [("f", "u")], True).lstrip()}""")
def cramers_v_two_by_two(spark, folder):
    flags = read_table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "y").otherwise("n").alias("f"),
        F.when(F.col("o_orderpriority") < "3", "y").otherwise("n").alias("u"),
    )
    return S.cramers_v(flags, ["f", "u"]).withColumn("v", r6("v"))


@query("T-4", sql=f"""
WITH {CUSTOMER_STATIC}, filled AS (SELECT coalesce(segment, 'BUILDING') AS segment, coalesce(outcome, 'Cured') AS outcome FROM static),
a AS ({_cramers_sql("static", [("segment", "outcome")], False)}), b AS ({_cramers_sql("filled", [("segment", "outcome")], False)})
SELECT a.a, a.b, a.v AS v_before, b.v AS v_after, round(b.v - a.v, 5) AS change FROM a JOIN b USING (a, b)""")
def association_before_after(spark, folder):
    static = customer_static(spark, folder).select("segment", "outcome")
    filled = static.fillna({"segment": "BUILDING", "outcome": "Cured"})
    pair = ["segment", "outcome"]
    table = S.compare_association(S.cramers_v(static, pair, yates=False), S.cramers_v(filled, pair, yates=False))
    return table.withColumns({"v_before": r6("v_before"), "v_after": r6("v_after"), "change": r6("change", 5)})


@query("T-8", "W10", sql="""
WITH r AS (
  SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS x,
         rank() OVER (ORDER BY month(o_orderdate)) + (count(*) OVER (PARTITION BY month(o_orderdate)) - 1) / 2.0::DOUBLE AS y
  FROM orders)
SELECT 'price' AS a, 'month' AS b, round(corr(x, y), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        F.col("o_totalprice").alias("price"), F.month("o_orderdate").alias("month")
    )
    return S.spearman(orders, [("price", "month")]).withColumn("rho", r6("rho"))


_LIMITS = """
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM src),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
c AS (SELECT src.*, LEAST(GREATEST(v, lo), hi) AS cv, lo, hi FROM src, f),
z AS (SELECT avg(cv) - 3 * stddev_samp(cv) AS zlo, avg(cv) + 3 * stddev_samp(cv) AS zhi FROM c)"""
_SKEWED = "WITH src AS (SELECT event_id, value AS v FROM events)"


@query("T-5", sql=f"""
{_SKEWED}, {_LIMITS}
SELECT event_id, round(LEAST(GREATEST(cv, zlo), zhi), 6) AS value FROM c, z""")
def outlier_cap(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "value")
    return S.cap_outliers(events, ["value"]).withColumn("value", r6("value"))


@query("T-5", sql=f"""
{_SKEWED}, {_LIMITS}
SELECT 'value' AS "column", count(*) FILTER (WHERE v < lo OR v > hi) AS iqr_outliers,
       count(*) FILTER (WHERE cv < zlo OR cv > zhi) AS z_outliers FROM c, z""")
def outlier_report(spark, folder):
    return S.outlier_report(read_table(spark, folder, "events"), ["value"])


@query("T-6", sql="""
WITH t AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st
           FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax
FROM lineitem, t""")
def standardize_train_only(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_shipdate"
    )
    fit = S.scale_fit(lines.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")), ["l_quantity", "l_tax"])
    out = S.standardize(lines.drop("l_shipdate"), fit, ["l_quantity", "l_tax"])
    return out.withColumns({c: r6(c) for c in ("l_quantity", "l_tax")})


_POINTS = [0, 25, 50, 100, 200]


@query("T-7", sql=f"""
WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events)
SELECT p::DOUBLE AS point, round(sum(exp(-pow((p - value) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density
FROM events, s, (SELECT unnest({_POINTS}) AS p) GROUP BY p""")
def density_curve(spark, folder):
    table = S.density(read_table(spark, folder, "events"), "value", _POINTS)
    return table.withColumn("density", r6("density", 8))
