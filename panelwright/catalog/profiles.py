"""Audit-table queries."""

from pyspark.sql import functions as F

from panelwright.catalog.inputs import (
    CUSTOMER_STATIC, EVENT_PANEL, SCORED_LINES, STATIC_NUMBERS, customer_static, event_panel, r6,
    scored_lines,
)
from panelwright.catalog.registry import query
from panelwright.operators import panel as P, profile as A
from panelwright.operators.evaluate import top_rows
from panelwright.operators.missing.fill import clip_static, indicator_fill_static
from panelwright.operators.windows import share_of_total
from panelwright.plans.dashboard import delay_status, due_checkin, regimen_rollup
from panelwright.sources.tables import read_table

_STATIC = ["balance", "credit", "nation", "score", "rare", "segment", "outcome"]


def _long_gaps(columns, table, keys=""):
    names = ", ".join(f"'{c}'" for c in columns)
    gaps = ", ".join(f"{c} IS NULL" for c in columns)
    return f'SELECT {keys} unnest([{names}]) AS "column", unnest([{gaps}]) AS gap FROM {table}'


@query("A1", "F9", sql=f"""
WITH {CUSTOMER_STATIC}, long AS ({_long_gaps(_STATIC, "static")})
SELECT "column", count(*) FILTER (WHERE gap) AS missing,
       round(count(*) FILTER (WHERE gap) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
       count(*) FILTER (WHERE gap) * 100.0::DOUBLE / count(*) >= 80 AS excluded
FROM long GROUP BY 1""")
def missing_by_column(spark, folder):
    return A.missing_by_column(customer_static(spark, folder), _STATIC)


@query("M1", sql=f"""
WITH {CUSTOMER_STATIC}, long AS ({_long_gaps(_STATIC, "static")})
SELECT "column", round(avg(CASE WHEN gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate
FROM long GROUP BY 1 HAVING count(*) FILTER (WHERE gap) > 0""")
def missing_rates(spark, folder):
    return A.missing_rates(customer_static(spark, folder), _STATIC).withColumn("rate", r6("rate"))


@query("A2", sql="""
WITH o AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price,
         CASE WHEN o_orderstatus <> 'P' OR year(o_orderdate) < 1999 THEN o_orderpriority END AS priority FROM orders),
long AS (SELECT year, unnest(['price', 'priority']) AS "column", unnest([price IS NULL, priority IS NULL]) AS gap FROM o)
SELECT year, "column", round(avg(CASE WHEN gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 2) AS missing_pct
FROM long GROUP BY 1, 2""")
def missing_by_year(spark, folder):
    year = F.year("o_orderdate")
    orders = read_table(spark, folder, "orders").select(
        year.alias("year"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"),
        F.when((F.col("o_orderstatus") != "P") | (year < 1999), F.col("o_orderpriority")).alias("priority"),
    )
    return A.missing_by_group(orders, "year", ["price", "priority"])


@query("A3", sql="SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def count_by_group(spark, folder):
    return A.group_counts(read_table(spark, folder, "orders"), "o_orderpriority")


@query("A4", "W12", "O2", sql=f"""
WITH {CUSTOMER_STATIC}, c AS (
  SELECT outcome AS value, count(*) AS count FROM static GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 4)
SELECT value, count, round(count * 100.0::DOUBLE / (SELECT sum(count) FROM c), 2) AS percent FROM c""")
def value_counts_top(spark, folder):
    return A.value_counts(customer_static(spark, folder), "outcome", top=4)


@query("A5", sql=f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       {", ".join(f"round(count(*) FILTER (WHERE o_orderpriority = '{p}') * 100.0::DOUBLE / count(*), 2) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))}
FROM orders GROUP BY 1""")
def crosstab_pct(spark, folder):
    orders = read_table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    return A.crosstab(orders, "year", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("A6", sql="""
SELECT p_brand, count(*) FILTER (WHERE p_type = 'SMALL') AS "SMALL", count(*) FILTER (WHERE p_type = 'LARGE') AS "LARGE"
FROM part GROUP BY 1""")
def pyramid(spark, folder):
    return A.crosstab(read_table(spark, folder, "part"), "p_brand", "p_type", ["SMALL", "LARGE"], percent=False)


_Q = ["l_quantity", "l_extendedprice", "l_tax"]


@query("A7", "A16", sql=f"""
WITH long AS (SELECT unnest([{", ".join(f"'{c}'" for c in _Q)}]) AS "column", unnest([{", ".join(_Q)}]) AS v FROM lineitem)
SELECT "column", count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
       round(quantile_cont(v, 0.75), 6) AS q3 FROM long GROUP BY 1""")
def quartiles(spark, folder):
    table = A.quartiles(read_table(spark, folder, "lineitem"), _Q)
    return table.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("A7", sql="""
SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM lineitem GROUP BY 1""")
def quartiles_by_group(spark, folder):
    table = A.quartiles(read_table(spark, folder, "lineitem"), ["l_extendedprice"], ["l_returnflag"], few_groups=True)
    return table.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("A8", sql="""
WITH v AS (SELECT l_quantity / 10 AS x FROM lineitem),
m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM v)
SELECT 'q' AS "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS min, max(x) AS max,
       round(quantile_cont(x, 0.5), 6) AS median, round(avg(pow((x - mu) / m.sd, 3)), 5) AS skewness,
       round(kurtosis_pop(x), 5) AS kurtosis, 0.0::DOUBLE AS missing_pct
FROM v, m""")
def describe(spark, folder):
    lines = read_table(spark, folder, "lineitem").select((F.col("l_quantity") / 10).alias("q"))
    table = A.describe(lines, ["q"])
    return table.withColumns({**{c: r6(c) for c in ("mean", "sd", "median")},
                              **{c: r6(c, 5) for c in ("skewness", "kurtosis")}})


@query("A9", sql="""
WITH m AS (
  SELECT count(*) AS a, min(year(o_orderdate)) AS b, max(year(o_orderdate)) AS c,
         count(*) / count(DISTINCT year(o_orderdate)) AS d, count(*) FILTER (WHERE o_orderstatus = 'F') AS e FROM orders)
SELECT unnest(['total', 'first_year', 'last_year', 'per_year', 'finished']) AS metric,
       unnest([a::DOUBLE, b::DOUBLE, c::DOUBLE, round(d::DOUBLE, 6), e::DOUBLE]) AS value FROM m""")
def kpi_table(spark, folder):
    year = F.year("o_orderdate")
    rows = F.count(F.lit(1))
    return A.kpi_table(read_table(spark, folder, "orders"), {
        "total": rows, "first_year": F.min(year), "last_year": F.max(year),
        "per_year": r6(rows / F.count_distinct(year)),
        "finished": F.count_if(F.col("o_orderstatus") == "F"),
    })


@query("A10", sql=f"""
WITH {CUSTOMER_STATIC}, m AS (
  SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE balance IS NOT NULL AND segment IS NOT NULL AND outcome IS NOT NULL)::DOUBLE AS ok,
         count(*) FILTER (WHERE balance IS NULL)::DOUBLE AS mb, count(*) FILTER (WHERE segment IS NULL)::DOUBLE AS ms,
         count(*) FILTER (WHERE outcome IS NULL)::DOUBLE AS mo,
         ({" + ".join(f"count({c})" for c in _STATIC)})::DOUBLE AS cells FROM static)
SELECT unnest(['total_records', 'complete_records', 'completeness_rate', 'missing_balance', 'missing_segment',
               'missing_outcome', 'average_completeness']) AS metric,
       unnest([n, ok, round(ok * 100 / n, 6), mb, ms, mo, round(cells * 100 / (n * {len(_STATIC)}), 6)]) AS value FROM m""")
def quality_table(spark, folder):
    table = A.quality_table(customer_static(spark, folder), ["balance", "segment", "outcome"], _STATIC)
    return table.withColumn("value", r6("value"))


@query("A11", sql="""
WITH long AS (SELECT unnest(['p_brand', 'p_type']) AS "column", unnest([p_brand, p_type]) AS v FROM part),
c AS (SELECT "column", v, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS r FROM long GROUP BY 1, 2)
SELECT "column", count(*) AS n_unique, CAST(0 AS BIGINT) AS missing,
       string_agg(v, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS top_values FROM c GROUP BY 1""")
def cardinality_audit(spark, folder):
    return A.cardinality_audit(read_table(spark, folder, "part"), ["p_brand", "p_type"])


@query("A14", sql="""
WITH d AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS a, o_orderdate - INTERVAL 78 YEAR AS b,
         o_orderdate + INTERVAL 30 YEAR AS c FROM orders)
SELECT unnest(['filled', 'old', 'late']) AS "column",
       unnest([count(a), count(b), count(c)]) AS parsed,
       unnest([count(*) FILTER (WHERE a IS NULL), 0, 0]) AS unparseable,
       unnest([0, 0, count(*) FILTER (WHERE year(c) > 2026)]) AS future,
       unnest([0, count(*) FILTER (WHERE year(b) < 1920), 0]) AS too_old FROM d""")
def date_anomalies(spark, folder):
    d = F.col("o_orderdate").cast("date")
    return A.date_anomalies(read_table(spark, folder, "orders"), {
        "filled": F.when(F.col("o_orderstatus") != "P", d), "old": F.add_months(d, -936), "late": F.add_months(d, 360),
    })


@query("A14", sql="""
SELECT 'ordered' AS earlier, 'shipped' AS later, count(*) FILTER (WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL) AS compared,
       count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def date_order_violations(spark, folder):
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey")
    dates = {"ordered": F.col("o_orderdate"), "shipped": F.col("l_shipdate")}
    return A.order_violations(rows, dates, [("ordered", "shipped")])


@query("A15", "M12", sql=f"""
WITH {CUSTOMER_STATIC}, m AS (
  SELECT (SELECT segment FROM static WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS seg,
         (SELECT outcome FROM static WHERE outcome IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS outc,
         (SELECT quantile_cont(balance, 0.5) FROM static) AS bal)
SELECT entity_id, coalesce(segment, seg) AS segment, coalesce(outcome, outc) AS outcome,
       round(coalesce(balance, bal), 6) AS balance FROM static, m""")
def safety_fill(spark, folder):
    from panelwright.operators.missing.fill import safety_fill as fill

    static = customer_static(spark, folder).select("entity_id", "segment", "outcome", "balance")
    return fill(static, skip=["entity_id"]).withColumn("balance", r6("balance"))


@query("A17", sql=f"""
WITH {SCORED_LINES}, c AS (SELECT label, count(*) AS count FROM scored GROUP BY 1)
SELECT label, count, round((SELECT max(count) FROM c) / (SELECT min(count) FROM c)::DOUBLE, 6) AS imbalance_ratio,
       round((SELECT sum(count) FROM c) / (2.0::DOUBLE * count), 6) AS weight FROM c""")
def class_balance(spark, folder):
    table = A.class_balance(scored_lines(spark, folder), "label")
    return table.withColumns({c: r6(c) for c in ("imbalance_ratio", "weight")})


@query("A18", sql="""
SELECT n_name, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def sorted_set_by_group(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nations = read_table(spark, folder, "nation")
    joined = customers.join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    return A.sorted_set(joined, "n_name", "c_mktsegment").select(
        "n_name", F.array_join("values", ", ").alias("segments")
    )


@query("A21", sql="""
WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_orderpriority, o_orderkey, o_totalprice FROM r WHERE n = 1""")
def best_by_group(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return A.best_by(orders, ["o_orderpriority"], F.col("o_totalprice"), "o_orderkey")


@query("O2", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return top_rows(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("W12", sql="""
WITH c AS (SELECT p_brand, count(*) AS parts FROM part GROUP BY 1)
SELECT p_brand, parts, round(parts / (SELECT sum(parts) FROM c)::DOUBLE, 6) AS share FROM c""")
def brand_share(spark, folder):
    counts = read_table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    return share_of_total(counts, "parts").withColumn("share", r6("share"))


@query("A20", sql="""
WITH e AS (
  SELECT user_id, min(CAST(ts AS DATE)) AS start, count(DISTINCT event_type) AS records, avg(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS d
  FROM events GROUP BY 1)
SELECT user_id, start IS NOT NULL AND records < 13 AND date_diff('day', start, DATE '2024-07-01') // 30 >= 1
         AND records < date_diff('day', start, DATE '2024-07-01') // 30 AS due,
       CASE WHEN d <= 3 THEN 'good' WHEN d <= 7 THEN 'moderate' ELSE 'poor' END AS delay FROM e""")
def due_checkins(spark, folder):
    day = F.col("ts").cast("date")
    start = F.lit("2024-01-01").cast("date")
    entities = read_table(spark, folder, "events").groupBy("user_id").agg(
        F.min(day).alias("start"), F.count_distinct("event_type").alias("records"),
        F.avg(F.datediff(day, start)).alias("d"),
    )
    return entities.select(
        "user_id", due_checkin(F.col("start"), F.col("records"), F.lit("2024-07-01").cast("date")).alias("due"),
        delay_status(F.col("d")).alias("delay"),
    )


@query("A20", "J5", sql=f"""
WITH {CUSTOMER_STATIC}
SELECT coalesce(segment, 'unassigned') AS regimen, count(*) AS entities, round(avg(nation / 25), 6) AS mean_risk,
       count(*) FILTER (WHERE nation / 25 - score / 300 < -0.05) AS improving,
       count(*) FILTER (WHERE nation / 25 - score / 300 > 0.05) AS worsening FROM static GROUP BY 1""")
def regimen_outcomes(spark, folder):
    static = customer_static(spark, folder).select(
        F.col("segment").alias("regimen"), (F.col("nation") / 25).alias("latest"),
        (F.col("score") / 300).alias("previous"),
    )
    return regimen_rollup(static).withColumn("mean_risk", r6("mean_risk"))


@query("T-7", sql="""
WITH x AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem),
b AS (SELECT CAST(LEAST(29, floor((l_extendedprice - low) / ((high - low) / 30))) AS INTEGER) AS bin, low, high, n FROM lineitem, x)
SELECT 'l_extendedprice' AS "column", bin, round(low + bin * ((high - low) / 30), 6) AS left_edge, count(*) AS count,
       round(count(*) / (n * ((high - low) / 30)), 9) AS density FROM b GROUP BY bin, low, high, n""")
def histogram(spark, folder):
    table = A.histogram(read_table(spark, folder, "lineitem"), ["l_extendedprice"])
    return table.withColumns({"left_edge": r6("left_edge"), "density": r6("density", 9)})


@query("X3", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderstatus_F",
       CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderstatus_O" FROM orders""")
def one_hot(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    train = orders.filter(F.col("o_orderstatus") != "P")
    return P.one_hot(orders, "o_orderstatus", P.vocabulary(train, "o_orderstatus"))


@query("X4", sql="""
WITH v AS (SELECT o_orderpriority AS value, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, code, value AS back FROM orders JOIN v ON value = o_orderpriority""")
def label_encode(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    codes = P.label_codes(orders, "o_orderpriority")
    coded = P.encode(orders, "o_orderpriority", codes).select("o_orderkey", F.col("o_orderpriority_code").alias("code"))
    return P.decode(coded, "code", codes, "back").select("o_orderkey", "code", "back")


@query("M19", "A10", sql=f"""
WITH {CUSTOMER_STATIC}, g AS (SELECT {" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in STATIC_NUMBERS)} AS nulls FROM static)
SELECT unnest(['no_identifiers', 'no_nulls', 'no_text_columns', 'all_finite', 'not_empty']) AS "check",
       unnest([true, nulls = 0, true, true, true]) AS passed,
       unnest([CAST(0 AS BIGINT), CAST(nulls AS BIGINT), 0, 0, 0]) AS failures FROM g""")
def quality_gates(spark, folder):
    return A.quality_gates(customer_static(spark, folder).select(*STATIC_NUMBERS), ["name_of_treatment_unit", "no"])


@query("M10", "M13", "P34", sql=f"""
WITH {CUSTOMER_STATIC}, m AS (SELECT quantile_cont(balance, 0.5) AS bal FROM static)
SELECT entity_id, CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS is_missing_age,
       CAST(round_even(LEAST(110, GREATEST(0, coalesce(balance, bal))), 0) AS BIGINT) AS age FROM static, m""")
def indicator_fill_and_clip(spark, folder):
    static = customer_static(spark, folder).select("entity_id", F.col("balance").alias("age"))
    return clip_static(indicator_fill_static(static, ["age"]))


@query("A12", "A23", "W1", "M10", sql=f"""
WITH {EVENT_PANEL}, f AS (
  SELECT entity_id, step, reading IS NULL AS gap,
         last_value(reading IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading
  FROM panel), m AS (SELECT quantile_cont(reading, 0.5) AS mid FROM f)
SELECT entity_id, step, round(coalesce(reading, mid), 6) AS reading, CASE WHEN gap THEN 1 ELSE 0 END AS is_missing_reading FROM f, m""")
def indicator_fill_panel(spark, folder):
    from panelwright.operators.missing.fill import indicator_fill_panel as fill

    panel = event_panel(spark, folder).select("entity_id", "step", "reading")
    return fill(panel, ["reading"], "entity_id").withColumn("reading", r6("reading"))
