"""Frames the queries share, and the same frames as SQL common table expressions.

``event_panel`` is the dense (entity, step) panel of the events table, ``order_panel`` that
of the orders table; ``customer_static`` holds one row per customer with natural gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.operators.panel import densify
from panelwright.sources.tables import read_table

METRICS = ("doses", "missed", "adherence", "weight", "reading", "smear")
ORDER_METRICS = ("amount", "n_orders", "urgent", "filled")
STATIC_NUMBERS = ("balance", "credit", "nation", "score", "rare")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def event_bins(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    step = F.least(F.lit(12), F.floor(day * 13 / 30).cast("int"))
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("entity_id"), step.alias("step"), "event_id", "ts", "event_type",
        "value",
    )


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    cells = event_bins(spark, folder).groupBy("entity_id", "step").agg(
        F.count_if(kind.isin("click", "view", "purchase")).cast("double").alias("doses"),
        F.count_if(kind == "error").cast("double").alias("missed"),
        F.avg(F.when(kind.isin("view", "click"), value)).alias("weight"),
        F.max(F.when(value >= 40 + 8 * F.col("step"), value)).alias("reading"),
        F.max(F.when(kind == "error", 1.0).when(kind == "signup", 0.0)).alias("smear"),
    )
    total = F.col("doses") + F.col("missed")
    return cells.withColumn("adherence", F.when(total > 0, F.col("doses") / total))


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    return densify(event_cells(spark, folder), "entity_id", "step", METRICS)


EVENT_PANEL = """
bins AS (
  SELECT user_id AS entity_id,
         CAST(LEAST(12, (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 13) // 30) AS INTEGER) AS step,
         event_id, ts, event_type, value
  FROM events),
cells AS (
  SELECT entity_id, step,
         CAST(count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS DOUBLE) AS doses,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS missed,
         avg(value) FILTER (WHERE event_type IN ('view', 'click')) AS weight,
         max(value) FILTER (WHERE value >= 40 + 8 * step) AS reading,
         max(CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.0::DOUBLE END) AS smear
  FROM bins GROUP BY 1, 2),
panel AS (
  SELECT e.entity_id, s.step, c.doses, c.missed,
         CASE WHEN c.doses + c.missed > 0 THEN c.doses / (c.doses + c.missed) END AS adherence,
         c.weight, c.reading, c.smear
  FROM (SELECT DISTINCT entity_id FROM bins) e
  CROSS JOIN (SELECT CAST(unnest(range(13)) AS INTEGER) AS step) s
  LEFT JOIN cells c ON c.entity_id = e.entity_id AND c.step = s.step)
"""


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    step = F.least(F.lit(12), F.floor(month / 6).cast("int"))
    cells = orders.groupBy(F.col("o_custkey").alias("entity_id"), step.alias("step")).agg(
        F.avg("o_totalprice").alias("amount"),
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.max(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1.0).otherwise(0.0)).alias("urgent"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("filled"),
    )
    return densify(cells, "entity_id", "step", ORDER_METRICS)


ORDER_PANEL = """
order_cells AS (
  SELECT o_custkey AS entity_id,
         CAST(LEAST(12, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) // 6) AS INTEGER) AS step,
         avg(o_totalprice) AS amount, CAST(count(*) AS DOUBLE) AS n_orders,
         max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS filled
  FROM orders GROUP BY 1, 2),
order_panel AS (
  SELECT e.entity_id, s.step, c.amount, c.n_orders, c.urgent, c.filled
  FROM (SELECT DISTINCT entity_id FROM order_cells) e
  CROSS JOIN (SELECT CAST(unnest(range(13)) AS INTEGER) AS step) s
  LEFT JOIN order_cells c ON c.entity_id = e.entity_id AND c.step = s.step)
"""


def customer_static(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with columns missing by rule, by correlation or almost always."""
    bal, nation, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    outcome = (
        F.when(segment == "BUILDING", "Cured")
        .when(segment == "AUTOMOBILE", "Treatment Completed")
        .when(segment == "FURNITURE", "Died")
        .when((segment == "HOUSEHOLD") & (nation < 12), "Cured")
        .when(segment == "HOUSEHOLD", "Lost to Follow-Up")
        .when(nation >= 5, "Treatment Completed")
    )
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.when(bal < 8500, bal).alias("balance"),
        F.when(segment != "MACHINERY", bal * 2 + nation).alias("credit"),
        nation.cast("double").alias("nation"),
        F.when(bal <= 3000, nation * 10.0).alias("score"),
        F.when(nation == 0, bal).alias("rare"),
        F.when(nation != 7, segment).alias("segment"),
        outcome.alias("outcome"),
    )


CUSTOMER_STATIC = """
static AS (
  SELECT c_custkey AS entity_id,
         CASE WHEN c_acctbal < 8500 THEN c_acctbal END AS balance,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal * 2 + c_nationkey END AS credit,
         CAST(c_nationkey AS DOUBLE) AS nation,
         CASE WHEN c_acctbal <= 3000 THEN c_nationkey * 10.0::DOUBLE END AS score,
         CASE WHEN c_nationkey = 0 THEN c_acctbal END AS rare,
         CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS segment,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Cured'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Treatment Completed'
              WHEN c_mktsegment = 'FURNITURE' THEN 'Died'
              WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 12 THEN 'Cured'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Lost to Follow-Up'
              WHEN c_nationkey >= 5 THEN 'Treatment Completed' END AS outcome
  FROM customer)
"""


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A scored table of lineitem size: returned lines are positive; the score mixes
    discount, tax and quantity into (0, 1)."""
    score = (
        0.2 + 2.0 * F.col("l_discount") + F.col("l_tax")
        + F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 100.0)
        .otherwise(F.col("l_quantity") / 160.0)
    )
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.col("l_linenumber") - 1).alias("step"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.round(score, 6).alias("score"),
    )


SCORED_LINES = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS step,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         round(0.2::DOUBLE + 2.0::DOUBLE * l_discount + l_tax
               + CASE WHEN l_returnflag = 'R' THEN l_quantity / 100.0::DOUBLE
                      ELSE l_quantity / 160.0::DOUBLE END, 6) AS score
  FROM lineitem)
"""


def attributions(spark: SparkSession, folder: str) -> DataFrame:
    """Signed contributions per order: one feature per line number, value from price and tax."""
    names = [
        "Treatment_Adherence", "Body_Weight", "Age", "Xpert_Result", "Missed_Doses",
        "Smear_Result", "Vital_Signs",
    ]
    lookup = F.array(*[F.lit(n) for n in names])
    value = (F.col("l_discount") - 0.05) * F.col("l_quantity") + F.col("l_tax")
    return (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("case_id"), F.get(lookup, F.col("l_linenumber") - 1).alias("feature"))
        .agg(F.round(F.sum(value), 6).alias("value"))
    )


ATTRIBUTIONS = """
attributions AS (
  SELECT l_orderkey AS case_id,
         list_extract(['Treatment_Adherence', 'Body_Weight', 'Age', 'Xpert_Result', 'Missed_Doses',
                       'Smear_Result', 'Vital_Signs'], l_linenumber) AS feature,
         round(sum((l_discount - 0.05::DOUBLE) * l_quantity + l_tax), 6) + 0.0::DOUBLE AS value
  FROM lineitem GROUP BY 1, 2)
"""


def correlation_p_sql(source: str, keep: str, r: str = "r", n: str = "n") -> str:
    """(keep..., p) of the two-sided t test of each correlation ``r`` over ``n`` pairs in ``source``.

    With sin(a) = |r|, the tail is one minus a multiple of the integral of cos^(n - 3) from 0
    to a, taken here by Simpson's rule over 4,000 steps.
    """
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    scale = f"exp(lgamma(({n} - 1) / 2.0::DOUBLE) - lgamma(({n} - 2) / 2.0::DOUBLE)) / sqrt(pi())"
    return f"""
SELECT {keep}, round(GREATEST(0.0::DOUBLE, 1 - 2 * {scale} * angle / 12000 * sum({weight} * pow(cos(angle * i / 4000), {n} - 3))), 6) AS p
FROM (SELECT *, asin(LEAST(abs({r}), 1.0::DOUBLE)) AS angle FROM {source} WHERE {n} >= 3 AND {r} IS NOT NULL AND NOT isnan({r})), range(4001) AS steps(i)
GROUP BY {keep}, {n}, angle"""
