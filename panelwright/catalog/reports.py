"""Reports: permuted courses, observed schemas, aligned codes and population roll-ups."""

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.catalog.inputs import (
    CUSTOMER_STATIC, EVENT_PANEL, ORDER_METRICS, ORDER_PANEL, customer_static, event_panel, order_panel, r6,
)
from panelwright.catalog.registry import query
from panelwright.operators import attribution as A, profile as P, schema as S, windows as W
from panelwright.operators.missing import handle
from panelwright.plans import audit
from panelwright.plans.dashboard import population_rollup as rollup
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources.tables import read_table

_GROUPS = {"doses": ["doses"], "missed": ["missed"], "both": ["doses", "missed"]}

_DEAL = f"""
{EVENT_PANEL}, pan AS (SELECT * FROM panel WHERE entity_id % 2 = 0),
rk AS (SELECT entity_id, repeat, count(*) OVER (PARTITION BY repeat) AS n, row_number() OVER (PARTITION BY repeat ORDER BY
         ('0x' || substr(md5(concat_ws(':', entity_id, repeat, 42)), 1, 15))::BIGINT, entity_id) AS r
       FROM (SELECT DISTINCT entity_id FROM pan), (SELECT unnest(range(3))::INTEGER AS repeat)),
pt AS (SELECT a.repeat, a.entity_id, b.entity_id AS partner FROM rk a JOIN rk b ON a.repeat = b.repeat AND b.r = a.r % a.n + 1)"""


def _held_out(spark, folder):
    return event_panel(spark, folder).select("entity_id", "step", "doses", "missed").filter("entity_id % 2 = 0")


@query("E1", sql=f"WITH {_DEAL} SELECT repeat, entity_id, partner FROM pt")
def trajectory_deal(spark, folder):
    """Whose course each held-out entity takes in each repeat."""
    return A.trajectory_partners(_held_out(spark, folder), "entity_id", 3)


@query("E1", "R11", sql=f"""
WITH {_DEAL}, g AS (SELECT unnest(['doses', 'missed', 'both']) AS grp),
s AS (SELECT entity_id, sum(coalesce(doses, 0)) AS d, sum(coalesce(missed, 0)) AS m, CASE WHEN sum(coalesce(missed, 0)) > 16 THEN 1 ELSE 0 END AS y FROM pan GROUP BY 1),
x AS (SELECT repeat, grp, s.y, CASE WHEN grp <> 'missed' THEN o.d ELSE s.d END AS d, CASE WHEN grp <> 'doses' THEN o.m ELSE s.m END AS m
      FROM pt JOIN s USING (entity_id) JOIN s o ON o.entity_id = partner, g UNION ALL SELECT -1, '', y, d, m FROM s),
p AS (SELECT repeat, grp, y, round(1 / (1 + exp(-(0.3 * m - 0.05 * d - 2))), 6) AS p FROM x),
r AS (SELECT *, rank() OVER (PARTITION BY repeat, grp ORDER BY p) + (count(*) OVER (PARTITION BY repeat, grp, p) - 1) / 2.0 AS rk FROM p),
a AS (SELECT repeat, grp, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc,
        2.0 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) / (2 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) + count(*) FILTER (WHERE (y = 1) <> (p >= 0.5))) AS f1 FROM r GROUP BY 1, 2),
b AS (SELECT auc AS base_auc, f1 AS base_f1 FROM a WHERE repeat = -1)
SELECT grp AS "group", round(avg(base_auc - auc), 6) AS auc_drop_mean, round(stddev_pop(base_auc - auc), 6) AS auc_drop_std, round(avg(base_f1 - f1), 6) AS f1_drop_mean
FROM a, b WHERE repeat >= 0 GROUP BY 1""")
def trajectory_importance(spark, folder):
    """What a fixed model loses when whole courses change hands between held-out entities."""
    panel = _held_out(spark, folder)
    missed, doses = (F.sum(F.coalesce(c, F.lit(0.0))) for c in ("missed", "doses"))
    labels = panel.groupBy("entity_id").agg((missed > 16).cast("int").alias("label"))

    def scorer(units):
        return units.groupBy("entity_id").agg(r6(1 / (1 + F.exp(-(0.3 * missed - 0.05 * doses - 2)))).alias("probability"))

    table = A.trajectory_importance(panel, "entity_id", "step", _GROUPS, labels, "label", scorer, repeats=3)
    return table.withColumns({c: r6(c) for c in table.columns if c != "group"})


_MIXED = {
    "code": "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS STRING) END",
    "amount": "CASE WHEN o_orderkey % 2 = 0 THEN concat(CAST(o_custkey AS STRING), '.5') ELSE CAST(o_custkey AS STRING) END",
    "day": "CASE WHEN o_orderkey % 3 = 0 THEN '2024-1-05' ELSE '7/12/2023' END",
    "mess": "CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN '2024-01-05' ELSE ' 1e5' END",
    "half": "CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-05' ELSE CAST(o_custkey AS STRING) END",
    "empty": "CASE WHEN o_orderkey % 2 = 0 THEN ' ' END",
    "priority": "o_orderpriority",
}
_KIND = " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for n, p in (("integer", S.INTEGER), ("decimal", S.DECIMAL), ("date", S.DATE)))


@query("P2", sql=f"""
WITH m AS ({" UNION ALL ".join(f'SELECT {chr(39)}{c}{chr(39)} AS "column", trim({e}) AS v FROM orders' for c, e in _MIXED.items())}),
k AS (SELECT "column", v, CASE WHEN v IS NULL OR v = '' THEN 'null' {_KIND} ELSE 'text' END AS kind FROM m),
c AS (SELECT "column", count(*) AS rows, {", ".join(f"count(*) FILTER (WHERE kind = '{n}') AS {n}s, min(v) FILTER (WHERE kind = '{n}') AS x_{n}" for n in S.LADDER)} FROM k GROUP BY 1)
SELECT "column", rows, nulls, integers, decimals, dates, texts, coalesce(x_text, x_date, x_decimal, x_integer) AS example, nulls = rows AS all_null,
  CASE WHEN texts > 0 OR (dates > 0 AND integers + decimals > 0) THEN 'text' WHEN dates > 0 THEN 'date' WHEN decimals > 0 THEN 'decimal' WHEN integers > 0 THEN 'integer' ELSE 'null' END AS observed
FROM c""")
def schema_report(spark, folder):
    """Observed types of text columns that hold numbers, dates, blanks and notes."""
    orders = read_table(spark, folder, "orders")
    return S.schema_report(orders.select(*[F.expr(e).alias(c) for c, e in _MIXED.items()]))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CODE = " ".join(f"WHEN '{s}' THEN {min(i, 3)}" for i, s in enumerate(_SEGMENTS))
_LABELLED = "CASE WHEN c_nationkey = 7 THEN ' ' WHEN c_custkey % 2 = 0 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END"
_CODED = f"CASE WHEN c_nationkey <> 3 THEN CASE c_mktsegment {_CODE} END + CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 11 = 0 THEN 7 ELSE 0 END END"


@query("J9", sql=f"""
WITH l AS (SELECT c_custkey AS k, nullif(trim({_LABELLED}), '') AS label FROM customer WHERE c_custkey % 37 <> 0),
c AS (SELECT c_custkey AS k, {_CODED} AS code FROM customer WHERE c_custkey % 31 <> 0),
p AS (SELECT label, code, count(*) AS rows, min(coalesce(l.k, c.k)) AS first_key FROM l FULL JOIN c ON l.k = c.k WHERE label IS NOT NULL OR code IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN label IS NULL THEN 0 ELSE count(*) FILTER (WHERE label IS NOT NULL AND code IS NOT NULL) OVER (PARTITION BY label) END AS codes_of_label,
  CASE WHEN code IS NULL THEN 0 ELSE count(*) FILTER (WHERE label IS NOT NULL AND code IS NOT NULL) OVER (PARTITION BY code) END AS labels_of_code FROM p)
SELECT *, CASE WHEN code IS NULL THEN 'only_label' WHEN label IS NULL THEN 'only_code' WHEN codes_of_label > 1 AND labels_of_code > 1 THEN 'both'
  WHEN codes_of_label > 1 THEN 'label_has_codes' WHEN labels_of_code > 1 THEN 'code_has_labels' ELSE 'aligned' END AS status FROM n""")
def code_alignment(spark, folder):
    """Segments as text in one table and as numbers in another: which pairs can be trusted."""
    people = read_table(spark, folder, "customer")
    labels = people.filter("c_custkey % 37 <> 0").select("c_custkey", F.expr(_LABELLED).alias("segment"))
    codes = people.filter("c_custkey % 31 <> 0").select("c_custkey", F.expr(_CODED).alias("number"))
    return S.align_codes(labels, codes, "c_custkey", "segment", "number")


_PEOPLE = {
    "sex": "CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END", "age": "CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 90 END",
    "regimen": "CASE c_nationkey % 4 WHEN 0 THEN 'hrze' WHEN 1 THEN 'mdr' WHEN 2 THEN 'xdr' END",
    "days_to_treatment": "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 12 END",
}
_ADHERENCE = "CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'partial' ELSE 'poor' END"


@query("A20", sql=f"""
WITH r AS (SELECT user_id, value / 500 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
t AS (SELECT user_id, max(CASE WHEN n = 1 THEN p END) AS latest, max(CASE WHEN n = 2 THEN p END) AS previous FROM r GROUP BY 1),
a AS (SELECT user_id, count(*) AS records, {", ".join(f"count(*) FILTER (WHERE {_ADHERENCE} = '{x}') AS {x}" for x in ("full", "partial", "poor"))} FROM events GROUP BY 1),
e AS (SELECT c_custkey, latest, previous, latest - previous AS delta, {", ".join(f"{e} AS {c}" for c, e in _PEOPLE.items())}, records, "full", partial, poor
      FROM customer LEFT JOIN t ON t.user_id = c_custkey LEFT JOIN a ON a.user_id = c_custkey),
b AS (SELECT coalesce(CASE WHEN latest >= 0.6 THEN 'HIGH' WHEN latest >= 0.35 THEN 'MED' WHEN latest IS NOT NULL THEN 'LOW' END, 'none') AS risk, coalesce(sex, 'none') AS sex,
  CASE WHEN age IS NULL THEN 'none' WHEN age <= 17 THEN '0-17' WHEN age <= 34 THEN '18-34' WHEN age <= 49 THEN '35-49' WHEN age <= 64 THEN '50-64' ELSE '65+' END AS age_band,
  coalesce(regimen, 'none') AS regimen, latest, delta, days_to_treatment, records, "full", partial, poor FROM e),
g AS (SELECT CASE WHEN risk IS NOT NULL THEN 'risk' WHEN sex IS NOT NULL THEN 'sex' WHEN age_band IS NOT NULL THEN 'age_band' WHEN regimen IS NOT NULL THEN 'regimen' ELSE 'all' END AS part,
  coalesce(risk, sex, age_band, regimen, 'all') AS value, count(*) AS entities, round(avg(latest), 6) AS mean_risk, count(*) FILTER (WHERE b.regimen <> 'none') AS on_treatment,
  count(*) FILTER (WHERE delta < -0.05) AS improving, count(*) FILTER (WHERE delta > 0.05) AS worsening, count(*) FILTER (WHERE delta BETWEEN -0.05 AND 0.05) AS stable,
  count(*) FILTER (WHERE delta IS NULL) AS without_trend, round(avg(days_to_treatment), 6) AS mean_days, coalesce(sum(records), 0)::BIGINT AS records,
  coalesce(sum("full"), 0)::BIGINT AS "full", coalesce(sum(partial), 0)::BIGINT AS partial, coalesce(sum(poor), 0)::BIGINT AS poor
  FROM b GROUP BY GROUPING SETS ((risk), (sex), (age_band), (regimen), ()))
SELECT *, CASE WHEN round(mean_days) <= 3 THEN 'good' WHEN round(mean_days) <= 7 THEN 'moderate' WHEN mean_days IS NOT NULL THEN 'poor' END AS delay,
  CASE WHEN records > 0 THEN CAST(round(100.0 * "full" / records) AS BIGINT) END AS full_pct FROM g""")
def population_rollup(spark, folder):
    """Customers as a population with their latest risks and check-ins: totals and four cuts."""
    events = read_table(spark, folder, "events").withColumn("p", F.col("value") / 500.0)
    latest = W.latest_trend(events, "user_id", "p", [F.desc("ts"), F.desc("event_id")]).select("user_id", "latest", "previous")
    people = read_table(spark, folder, "customer").select("c_custkey", *[F.expr(e).alias(c) for c, e in _PEOPLE.items()])
    entities = people.join(latest, F.col("user_id") == F.col("c_custkey"), "left").drop("user_id")
    records = events.select(F.col("user_id").alias("c_custkey"), F.expr(_ADHERENCE).alias("adherence"))
    return rollup(entities, records, "c_custkey").withColumns({c: r6(c) for c in ("mean_risk", "mean_days")})


_STATIC = ("balance", "credit", "nation", "segment")


def _nulls(table, columns):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns) + f" FROM {table}"


@query("M18", "S11", "E12", sql=f"""
WITH {CUSTOMER_STATIC}, {ORDER_PANEL}
SELECT 'before' AS section, 'static.rows' AS name, count(*)::VARCHAR AS value FROM static
UNION ALL SELECT 'before', 'panel.rows', count(*)::VARCHAR FROM order_panel
UNION ALL SELECT 'before', 'static.columns', '{len(_STATIC) + 1}' UNION ALL SELECT 'before', 'panel.columns', '{len(ORDER_METRICS) + 2}'
UNION ALL SELECT 'before', 'static.null_cells', ({_nulls("static", _STATIC).replace(" FROM", ")::VARCHAR FROM")}
UNION ALL SELECT 'before', 'panel.null_cells', ({_nulls("order_panel", ORDER_METRICS).replace(" FROM", ")::VARCHAR FROM")}
UNION ALL SELECT 'after', 'static.rows', count(*)::VARCHAR FROM static UNION ALL SELECT 'after', 'panel.rows', count(*)::VARCHAR FROM order_panel
UNION ALL SELECT 'after', 'static.null_cells', '0' UNION ALL SELECT 'after', 'panel.null_cells', '0'
{" ".join(f"UNION ALL SELECT 'before_nulls', 'static.{c}', count(*) FILTER (WHERE {c} IS NULL)::VARCHAR FROM static" for c in ("entity_id", *_STATIC))}
{" ".join(f"UNION ALL SELECT 'before_nulls', 'panel.{c}', count(*) FILTER (WHERE {c} IS NULL)::VARCHAR FROM order_panel" for c in ("entity_id", "step", *ORDER_METRICS))}
{" ".join(f"UNION ALL SELECT 'missing_rate', 'static.{c}', printf('%.2f', 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)) FROM static HAVING count({c}) < count(*)" for c in _STATIC)}
{" ".join(f"UNION ALL SELECT 'missing_rate', 'panel.{c}', printf('%.2f', 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)) FROM order_panel HAVING count({c}) < count(*)" for c in ORDER_METRICS)}""")
def missing_audit(spark, folder):
    """The audit report of a missing-data run, written with its manifest and read back."""
    before = {
        "static": audit.watch(customer_static(spark, folder).select("entity_id", *_STATIC)),
        "panel": audit.watch(order_panel(spark, folder).select("entity_id", "step", *ORDER_METRICS)),
    }
    done = handle.handle_missing(
        before["static"].table, before["panel"].table, "entity_id", list(_STATIC), list(ORDER_METRICS), imputer="linear", max_rounds=1)
    after = {"static": audit.watch(done.static), "panel": audit.watch(done.panel)}
    facts = [{name: w.facts for name, w in side.items()} for side in (before, after)]
    path = f"{ensure_checkpoint_dir(spark)}/audit-{uuid4().hex}"
    audit.write_audit(spark, audit.audit_report(done, *facts, {"imputer": "linear"}), path)
    rows = audit.audit_rows(spark, audit.read_audit(spark, path))
    return rows.filter("section <> 'pathways' AND NOT (section = 'after' AND name LIKE '%.columns')")


@query("M19", "P27", "S10", sql="""
SELECT unnest(['o_orderkey', 'o_totalprice', 'weight', 'day', 'o_orderpriority', 'maybe']) AS "column", count(*) AS rows, count(*) AS rows_back, true AS passed FROM orders""")
def export_checked(spark, folder):
    """Orders as a readable CSV with units and dates, each column compared after reading it back."""
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_custkey") % 90).cast("double").alias("weight"), F.col("o_orderdate").cast("date").alias("day"),
        "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("maybe"))
    return audit.export_readable(orders, f"{ensure_checkpoint_dir(spark)}/export-{uuid4().hex}", "o_orderkey", {"weight": "kg"})


@query("M19", "A10", sql="""
WITH g AS (SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) + count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS nulls, count(*) FILTER (WHERE c_custkey % 7 = 0 AND c_custkey % 3 <> 0) AS odd FROM customer)
SELECT unnest(['no_identifiers', 'no_nulls', 'no_text_columns', 'all_finite', 'not_empty']) AS "check", unnest([false, nulls = 0, false, odd = 0, true]) AS passed,
  unnest([1, nulls, 1, odd, 0]::BIGINT[]) AS failures FROM g""")
def quality_gates_failing(spark, folder):
    """The gates on a table that breaks four of them."""
    rows = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("no"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("balance"))
    return P.quality_gates(rows, ["name_of_treatment_unit", "no"])
