"""Panel reshaping and per-entity window queries."""

from pyspark.sql import functions as F

from panelwright.catalog.inputs import (
    CUSTOMER_STATIC, EVENT_PANEL, METRICS, ORDER_METRICS, ORDER_PANEL, customer_static,
    event_bins, event_cells, event_panel, order_panel, r6,
)
from panelwright.catalog.registry import query
from panelwright.operators import panel as P, windows as W
from panelwright.operators.features import dense_ids
from panelwright.operators.profile import entity_observation, retention_cascade as cascade
from panelwright.operators.profile import step_missing_rate as missing_rate
from panelwright.sources.cases import child_array, nested_documents, search_entities
from panelwright.sources.tables import read_table

_SEEN = "coalesce(doses, missed, adherence, weight, reading, smear)"
_MEANS = [m for m in METRICS if m != "weight"]
_HIST = "OVER (PARTITION BY entity_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("A12", sql=f"""
WITH {EVENT_PANEL}
SELECT step, count(*) FILTER (WHERE {_SEEN} IS NOT NULL) AS active,
       round(count(*) FILTER (WHERE {_SEEN} IS NOT NULL) * 100.0::DOUBLE / count(*), 2) AS retained_pct,
       round(100 - count(*) FILTER (WHERE {_SEEN} IS NOT NULL) * 100.0::DOUBLE / count(*), 2) AS decay_pct,
       count(adherence) AS focus_obs
FROM panel GROUP BY step""")
def retention_cascade(spark, folder):
    return cascade(event_panel(spark, folder), METRICS, "adherence")


@query("A23", sql=f"""
WITH {EVENT_PANEL}, long AS (
  SELECT step, unnest(['doses','missed','adherence','weight','reading','smear']) AS "column",
         unnest([doses IS NULL, missed IS NULL, adherence IS NULL, weight IS NULL, reading IS NULL, smear IS NULL]) AS gap
  FROM panel)
SELECT step, "column", round(avg(CASE WHEN gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS missing_rate
FROM long GROUP BY 1, 2""")
def step_missing_rate(spark, folder):
    table = missing_rate(event_panel(spark, folder), METRICS)
    return table.withColumn("missing_rate", r6("missing_rate"))


_WIDE = ", ".join(
    f"round(max(CASE WHEN step = {s} THEN {m} END), 6) AS m{s}_{m}"
    for s in range(13) for m in ("doses", "weight", "smear")
)


@query("X2", sql=f"WITH {EVENT_PANEL} SELECT entity_id, {_WIDE} FROM panel GROUP BY entity_id")
def panel_pivot_wide(spark, folder):
    panel = event_panel(spark, folder).withColumn("weight", r6("weight"))
    return P.panel_to_wide(panel, "entity_id", ["doses", "weight", "smear"])


@query("X1", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, doses, round(weight, 6) AS weight FROM panel""")
def panel_unpivot_long(spark, folder):
    wide = P.panel_to_wide(event_panel(spark, folder), "entity_id", ["doses", "weight"])
    _, panel = P.wide_to_panel(wide, "entity_id")
    return panel.withColumn("weight", r6("weight"))


@query("J1", "P34", sql=f"""
WITH {ORDER_PANEL}, {CUSTOMER_STATIC}, wide AS (
  SELECT entity_id, {", ".join(f"max(CASE WHEN step = {s} THEN n_orders END) AS m{s}_n_orders" for s in range(13))}
  FROM order_panel GROUP BY entity_id)
SELECT s.entity_id, s.segment, CASE WHEN s.segment IS NULL THEN 1 ELSE 0 END AS is_missing_segment,
       {", ".join(f"w.m{s}_n_orders" for s in range(13))}
FROM static s LEFT JOIN wide w ON w.entity_id = s.entity_id""")
def static_join_wide(spark, folder):
    wide = P.panel_to_wide(order_panel(spark, folder), "entity_id", ["n_orders"])
    static = customer_static(spark, folder).select(
        "entity_id", "segment", F.col("segment").isNull().cast("int").alias("is_missing_segment")
    )
    return P.join_static(static, wide, "entity_id")


@query("W1", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, reading AS raw,
       last_value(reading IGNORE NULLS) {_HIST} AS filled
FROM panel""")
def forward_fill(spark, folder):
    return event_panel(spark, folder).select(
        "entity_id", "step", F.col("reading").alias("raw"),
        W.forward_fill("reading", "entity_id").alias("filled"),
    )


@query("W2", "M13", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, CASE WHEN reading IS NOT NULL THEN max(reading) {_HIST} END AS reading
FROM panel""")
def running_max_repair(spark, folder):
    panel = event_panel(spark, folder).select("entity_id", "step", "reading")
    return W.repair_monotone(panel, "reading", "entity_id")


@query("A24", "W3", sql=f"""
WITH {EVENT_PANEL}, d AS (
  SELECT entity_id, reading - lag(reading) OVER (PARTITION BY entity_id ORDER BY step) AS diff FROM panel)
SELECT entity_id, count(*) FILTER (WHERE diff < 0) AS violations FROM d GROUP BY entity_id""")
def monotonic_violations(spark, folder):
    return W.monotone_violations(event_panel(spark, folder), "reading", "entity_id")


def _prefix_sql(m):
    return f"""
       round(avg({m}) {_HIST}, 6) AS mean_{m}, round(stddev_pop({m}) {_HIST}, 6) AS std_{m},
       min({m}) {_HIST} AS min_{m}, max({m}) {_HIST} AS max_{m},
       round(CASE WHEN stddev_pop({m}) {_HIST} > 1e-8
             THEN coalesce(regr_slope({m}, step) {_HIST}, 0) ELSE 0 END, 6) + 0.0::DOUBLE AS trend_{m},
       {m} AS latest_{m}"""


@query("W5", "W6", "R1", "X6", sql=f"""
WITH {EVENT_PANEL}, z AS (
  SELECT entity_id, step, coalesce(doses, 0) AS doses, coalesce(reading, 0) AS reading FROM panel)
SELECT entity_id, step, {_prefix_sql("doses")}, {_prefix_sql("reading")}, step AS months_available
FROM z""")
def prefix_features(spark, folder):
    table = W.prefix_features(event_panel(spark, folder), ["doses", "reading"], "entity_id")
    noisy = [c for c in table.columns if c.startswith(("mean_", "std_", "trend_"))]
    return table.withColumns({c: r6(c) for c in noisy})


@query("W7", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, sum(coalesce(doses, 0)) {_HIST} AS running_doses FROM panel""")
def running_dose(spark, folder):
    panel = event_panel(spark, folder).select("entity_id", "step", F.coalesce("doses", F.lit(0.0)).alias("doses"))
    return panel.select("entity_id", "step", W.running_sum("doses", "entity_id").alias("running_doses"))


@query("W11", sql=f"""
WITH {EVENT_PANEL}, l AS (
  SELECT entity_id, step, lag(step) OVER (PARTITION BY entity_id ORDER BY step) AS prev FROM cells)
SELECT entity_id, step, CASE WHEN prev IS NULL THEN step IN (0, 1) ELSE step = prev + 1 END AS expected
FROM l""")
def contiguous_steps(spark, folder):
    cells = event_cells(spark, folder)
    return cells.select("entity_id", "step", W.contiguous(cells, "entity_id").alias("expected"))


_LATEST = """
ranked AS (
  SELECT user_id AS entity_id, value / 500.0::DOUBLE AS p,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
two AS (
  SELECT entity_id, max(CASE WHEN rn = 1 THEN p END) AS latest, max(CASE WHEN rn = 2 THEN p END) AS previous
  FROM ranked WHERE rn <= 2 GROUP BY entity_id)"""


@query("W4", "T4", sql=f"""
WITH {_LATEST}
SELECT entity_id, round(latest, 6) AS latest, round(previous, 6) AS previous,
       round(latest - previous, 6) AS delta,
       CASE WHEN latest - previous < -0.05 THEN 'improving' WHEN latest - previous > 0.05 THEN 'worsening'
            WHEN latest - previous IS NOT NULL THEN 'stable' END AS trend
FROM two""")
def latest_trend(spark, folder):
    bins = event_bins(spark, folder).withColumn("p", F.col("value") / 500.0)
    table = W.latest_trend(bins, "entity_id", "p", [F.desc("ts"), F.desc("event_id")])
    return table.withColumns({c: r6(c) for c in ("latest", "previous", "delta")})


@query("A20", "P32", sql=f"""
WITH {_LATEST}, banded AS (
  SELECT *, CASE WHEN latest >= 0.6 THEN 'HIGH' WHEN latest >= 0.35 THEN 'MED' ELSE 'LOW' END AS risk FROM two)
SELECT risk, count(*) AS entities, round(avg(latest), 6) AS mean_risk,
       count(*) FILTER (WHERE latest - previous < -0.05) AS improving,
       count(*) FILTER (WHERE latest - previous > 0.05) AS worsening,
       count(*) FILTER (WHERE previous IS NULL) AS without_trend
FROM banded GROUP BY risk""")
def trend_rollup(spark, folder):
    from panelwright.plans.dashboard import risk_rollup

    bins = event_bins(spark, folder).withColumn("p", F.col("value") / 500.0)
    latest = W.latest_trend(bins, "entity_id", "p", [F.desc("ts"), F.desc("event_id")])
    return risk_rollup(latest).withColumn("mean_risk", r6("mean_risk"))


@query("A13", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id,
       {", ".join(f"round(avg({m}) FILTER (WHERE step <= 7), 6) AS mean_{m}" for m in _MEANS)},
       coalesce(max(step) FILTER (WHERE step <= 7 AND {_SEEN} IS NOT NULL), -1) AS last_step,
       count(*) FILTER (WHERE step <= 7 AND {_SEEN} IS NOT NULL) AS steps_observed
FROM panel GROUP BY entity_id""")
def entity_observed_means(spark, folder):
    table = entity_observation(event_panel(spark, folder), METRICS, "entity_id").drop("mean_weight")
    return table.withColumns({f"mean_{m}": r6(f"mean_{m}") for m in _MEANS})


@query("J2", sql=f"""
WITH {ORDER_PANEL}, {CUSTOMER_STATIC}, means AS (
  SELECT entity_id, {", ".join(f"avg({m}) AS {m}_mean" for m in ORDER_METRICS)} FROM order_panel GROUP BY 1)
SELECT s.entity_id, s.outcome, {", ".join(f"round(m.{m}_mean, 6) AS {m}_mean" for m in ORDER_METRICS[1:])}
FROM static s LEFT JOIN means m ON m.entity_id = s.entity_id""")
def static_join_means(spark, folder):
    means = order_panel(spark, folder).groupBy("entity_id").agg(
        *[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in ORDER_METRICS[1:]]
    )
    return P.join_static(customer_static(spark, folder).select("entity_id", "outcome"), means, "entity_id")


@query("X5", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id,
       string_agg(CAST(CAST(coalesce(doses, 0) AS INTEGER) AS VARCHAR) || ':' ||
                  CAST(CAST(coalesce(smear, 0) AS INTEGER) AS VARCHAR), '|' ORDER BY step) AS cells
FROM panel GROUP BY entity_id""")
def sequence_assembly(spark, folder):
    seq = P.sequences(event_panel(spark, folder), "entity_id", ["doses", "smear"])
    cell = lambda s: F.concat_ws(":", F.transform(s, lambda x: x.cast("int").cast("string")))
    return seq.select("entity_id", F.array_join(F.transform("sequence", cell), "|").alias("cells"))


@query("X6", "X5", sql=f"""
WITH {EVENT_PANEL}, z AS (SELECT entity_id, step, coalesce(doses, 0) AS doses FROM panel)
SELECT a.entity_id, a.step, a.step + 1 AS seq_len, round(sum(b.doses), 6) AS visible_sum, 13 AS length
FROM z a JOIN z b ON b.entity_id = a.entity_id AND b.step <= a.step GROUP BY 1, 2""")
def progressive_sequences(spark, folder):
    seq = P.sequences(event_panel(spark, folder), "entity_id", ["doses"])
    samples = P.progressive_samples(seq, "entity_id", 1)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[0])
    return samples.select(
        "entity_id", "step", "seq_len", r6(total).alias("visible_sum"), F.size("sequence").alias("length")
    )


@query("O4", "O2", sql=f"""
WITH ranked AS (
  SELECT user_id AS entity_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events)
SELECT entity_id, event_id, event_type, CAST(recency AS INTEGER) AS recency FROM ranked WHERE recency <= 3""")
def last_three_events(spark, folder):
    bins = event_bins(spark, folder)
    last = W.last_rows(bins, "entity_id", [F.desc("ts"), F.desc("event_id")], 3)
    return last.select("entity_id", "event_id", "event_type", "recency")


@query("O1", "O3", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, doses FROM panel ORDER BY entity_id, step DESC""")
def panel_sorted_export(spark, folder):
    return event_panel(spark, folder).select("entity_id", "step", "doses").orderBy("entity_id", F.desc("step"))


@query("P3", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders""")
def dense_row_ids(spark, folder):
    return dense_ids(read_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("S13", "J10", sql=f"""
WITH {EVENT_PANEL}, kinds AS (SELECT entity_id, step, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS seen FROM bins GROUP BY 1, 2)
SELECT c.entity_id, count(*) AS records, string_agg(c.step || ':' || CAST(c.doses AS INTEGER) || ':' || seen, '|' ORDER BY c.step) AS document
FROM cells c JOIN kinds k ON k.entity_id = c.entity_id AND k.step = c.step GROUP BY 1""")
def nested_entity_documents(spark, folder):
    """One document per user: step records, and the event kinds seen per step as attachments."""
    cells = event_cells(spark, folder)
    kinds = event_bins(spark, folder).select("entity_id", "step", "event_type").distinct()
    attached = kinds.groupBy("entity_id", "step").agg(
        F.array_sort(F.collect_list("event_type")).alias("attachments")
    )
    records = cells.join(attached, ["entity_id", "step"], "left")
    child = child_array(records, "entity_id", ["step"], ["doses", "attachments"], "records")
    people = cells.select("entity_id").distinct()
    documents = nested_documents(people, "entity_id", [child])

    def line(r):
        return F.concat_ws(":", r["step"], r["doses"].cast("int"), F.array_join(r["attachments"], "+"))

    return documents.select(
        "entity_id", F.size("records").cast("long").alias("records"),
        F.array_join(F.transform("records", line), "|").alias("document"),
    )


@query("F10", sql="""
SELECT c_custkey, c_name FROM customer
WHERE lower(c_name) LIKE '%9%' OR CAST(c_custkey AS VARCHAR) LIKE '%9%'""")
def entity_search(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    return search_entities(customers, "9", ["c_name", "c_custkey"])


@query("X1", "X5", sql="""
WITH d AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS INTEGER) AS step FROM events)
SELECT step, count(*) AS rows FROM d WHERE step IS NULL OR step NOT BETWEEN 0 AND 12 GROUP BY 1""")
def steps_beyond_panel(spark, folder):
    """Rows per step that a panel of steps 0 to 12 has no place for, with two days a step."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return P.steps_outside(read_table(spark, folder, "events").select(F.floor(day / 2).cast("int").alias("step")), "step")
