"""Parsing, harmonisation, repair and filter queries.

Raw text in the forms a register contains is derived from the table rows; the SQL side
states the expected value from the same rows without going through that text where it can.
"""

from pyspark.sql import functions as F

from panelwright import fixed_values as V
from panelwright.catalog.inputs import CUSTOMER_STATIC, customer_static, r6
from panelwright.catalog.registry import query
from panelwright.functions import categories as C, dates as D, numeric as N, parsing as P, text as T
from panelwright.operators.features import drop_policy, observed_labels
from panelwright.operators.ordering import attach, medians
from panelwright.sources.cases import json_field
from panelwright.sources.registers import drop_repeated_headers
from panelwright.sources.sinks import readable
from panelwright.sources.tables import read_table


def pick(column, cases, other=None):
    """CASE over the values of one column."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, result in cases.items():
        out = out.when(F.col(column) == value, result)
    return out.otherwise(other)


@query("P4", "P10", sql="""
SELECT p_partkey,
       CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') THEN CAST(p_size AS DOUBLE)
            WHEN p_type = 'PROMO' THEN p_size + 0.5::DOUBLE END AS weight_kg,
       CASE WHEN p_type IN ('LARGE', 'SMALL') THEN NULL ELSE CAST(p_size + 100 AS DOUBLE) END AS number
FROM part""")
def parse_measure(spark, folder):
    size = F.col("p_size").cast("string")
    raw = pick("p_type", {
        "STANDARD": F.concat(size, F.lit("kg")), "ECONOMY": F.concat(F.lit(" "), size, F.lit(" KG ")),
        "MEDIUM": F.concat(size, F.lit("kgs")), "PROMO": F.concat(size, F.lit(".5 kg")), "LARGE": "n/a",
    }, "")
    number = pick("p_type", {"LARGE": F.concat(size, F.lit("x")), "SMALL": "NaN"},
                  F.concat(F.lit(" "), (F.col("p_size") + 100).cast("string")))
    return read_table(spark, folder, "part").select(
        "p_partkey", P.parse_measure(raw, "kg").alias("weight_kg"), P.to_number(number).alias("number")
    )


@query("P5", sql="""
SELECT p_partkey,
       CASE WHEN p_type <> 'LARGE' THEN CAST(p_size + 80 AS DOUBLE) END AS systolic,
       CASE WHEN p_type <> 'LARGE' THEN CAST(p_size + 40 AS DOUBLE) END AS diastolic
FROM part""")
def split_ratio(spark, folder):
    high, low = (F.col("p_size") + 80).cast("string"), (F.col("p_size") + 40).cast("string")
    raw = pick("p_type", {
        "LARGE": F.concat(F.lit("n/a "), high), "SMALL": F.concat(high, F.lit(" / "), low, F.lit(" mmHg")),
    }, F.concat(F.lit(" "), high, F.lit("/"), low))
    systolic, diastolic = P.split_ratio(raw)
    return read_table(spark, folder, "part").select(
        "p_partkey", systolic.alias("systolic"), diastolic.alias("diastolic")
    )


@query("P6", sql="""
WITH v AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
         CAST(round(100 - 100 * l_discount) AS INTEGER) AS pct, CAST(l_quantity AS INTEGER) AS q
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_returnflag = 'R' THEN CAST(pct AS DOUBLE)
            WHEN l_returnflag = 'A' AND pct < 100 THEN CAST(pct AS DOUBLE)
            WHEN l_returnflag = 'N' AND q = 1 THEN 100.0::DOUBLE END AS saturation
FROM v""")
def parse_saturation(spark, folder):
    pct = F.round(100 - 100 * F.col("l_discount")).cast("int").cast("string")
    raw = pick("l_returnflag", {
        "R": F.concat(pct, F.lit("% ")), "A": F.concat(F.lit("0."), pct),
        "N": F.col("l_quantity").cast("int").cast("string"),
    })
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", P.parse_saturation(raw).alias("saturation")
    )


@query("P7", "P31", "P32", sql="""
SELECT l_orderkey, l_linenumber, l_partkey,
       round(CASE WHEN l_quantity = 1 THEN 1.0::DOUBLE ELSE l_quantity / 100.0::DOUBLE END, 6) AS share,
       CASE WHEN l_quantity = 1 OR l_quantity / 100.0::DOUBLE >= 0.9 THEN 'full'
            WHEN l_quantity / 100.0::DOUBLE >= 0.5 THEN 'partial' ELSE 'poor' END AS band,
       round(l_quantity / (l_quantity + 10), 6) AS kept_share,
       round(LEAST(0.95::DOUBLE, l_quantity / 40.0::DOUBLE), 6) AS clamped,
       CASE WHEN l_quantity / 40.0::DOUBLE >= 0.7 THEN 'HIGH'
            WHEN l_quantity / 40.0::DOUBLE >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM lineitem""")
def parse_proportion(spark, folder):
    whole = F.col("l_quantity").cast("int").cast("string")
    share = P.parse_proportion(F.concat(F.lit(" "), whole, F.lit("%")))
    p = F.col("l_quantity") / 40.0
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(share).alias("share"),
        N.adherence_band(share).alias("band"),
        r6(N.adherence_share(F.col("l_quantity"), F.lit(10.0))).alias("kept_share"),
        r6(N.clamp_probability(p)).alias("clamped"),
        N.risk_band(p).alias("risk"),
    )


@query("P9", "P11", sql="""
SELECT event_id,
       CASE event_type WHEN 'click' THEN 0.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE
            WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN 1.0::DOUBLE END AS smear,
       CASE event_type WHEN 'click' THEN 0.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE
            WHEN 'purchase' THEN 1.0::DOUBLE END AS smear_strict,
       CASE event_type WHEN 'click' THEN 0.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE
            WHEN 'purchase' THEN 1.0::DOUBLE END AS lenient
FROM events""")
def binary_result(spark, folder):
    raw = pick("event_type", {
        "click": " Negative", "view": "MTB not detected", "purchase": "MTB Detected", "error": "not done",
    }, "")
    return read_table(spark, folder, "events").select(
        "event_id", P.smear_result(raw).alias("smear"),
        P.xpert_result(raw, unknown="null").alias("smear_strict"),
        P.parse_lenient(raw).alias("lenient"),
    )


@query("P8", sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_orderstatus <> 'P'
            THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed
FROM orders""")
def parse_mixed_date(spark, folder):
    d = F.col("o_orderdate")
    text = pick("o_orderpriority", {
        "1-URGENT": F.date_format(d, "M/d/yyyy"),
        "2-HIGH": F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit("= ")),
        "3-MEDIUM": F.date_format(d, "yyyy-MM-dd"),
        "4-NOT SPECIFIED": F.when(F.col("o_orderstatus") == "P", F.date_format(d, "'13/45/'yyyy"))
        .otherwise(F.date_format(d, "M/d/yy")),
    }, F.when(F.dayofmonth(d) > 12, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "M-d-yyyy")))
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(D.parse_mixed_date(text), "yyyy-MM-dd").alias("parsed")
    )


@query("P12", "P13", "P14", sql="""
SELECT o_orderkey,
       strftime(CASE o_orderstatus WHEN 'P' THEN o_orderdate - INTERVAL 70 YEAR
                WHEN 'F' THEN o_orderdate + INTERVAL 40 YEAR - INTERVAL 100 YEAR
                ELSE o_orderdate - INTERVAL 90 YEAR + INTERVAL 100 YEAR END, '%Y-%m-%d') AS born,
       strftime(CASE WHEN year(o_orderdate) + 32 > 2027 THEN o_orderdate + INTERVAL 32 YEAR - INTERVAL 10 YEAR
                ELSE o_orderdate + INTERVAL 32 YEAR END, '%Y-%m-%d') AS clinical,
       strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate + INTERVAL 5 DAY END, '%Y-%m-%d') AS started
FROM orders""")
def repair_dates(spark, folder):
    d = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    born = F.when(status == "P", F.add_months(d, -840)).when(status == "F", F.add_months(d, 480)).otherwise(
        F.add_months(d, -1080)
    )
    start = F.when(status == "F", F.date_sub(d, 3)).otherwise(F.date_add(d, 5))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        show(D.fix_birth_year(born, 2025)).alias("born"),
        show(D.fix_future_year(F.add_months(d, 384), 2025)).alias("clinical"),
        show(D.enforce_order(start, d)).alias("started"),
    )


@query("P15", "A16", sql="""
WITH m AS (
  SELECT CAST(floor(quantile_cont(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), 0.5)) AS INTEGER) AS mid
  FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, strftime(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE)
       ELSE DATE '1970-01-01' + mid END, '%Y-%m-%d') AS filled
FROM orders, m""")
def median_date_fill(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", D.epoch_day(F.col("o_orderdate"))).alias("day")
    )
    wide = attach(orders, medians(orders, ["day"]), "_m")
    day = F.coalesce("day", F.col("_m.day"))
    return wide.select(
        "o_orderkey", F.date_format(F.date_from_unix_date(F.floor(day).cast("int")), "yyyy-MM-dd").alias("filled")
    )


@query("P16", "P17", "P28", sql="""
SELECT c_custkey,
       CASE WHEN c_acctbal IS NOT NULL THEN LEAST(GREATEST(c_acctbal, 1000), 8000) END AS clipped,
       CASE WHEN c_nationkey BETWEEN 3 AND 20 THEN c_nationkey END AS kept,
       CASE WHEN c_nationkey > 0 AND c_nationkey <= 10 THEN '0-10' WHEN c_nationkey > 10 AND c_nationkey <= 20 THEN '10-20'
            WHEN c_nationkey > 20 AND c_nationkey <= 30 THEN '20-30' END AS right_bin,
       CASE WHEN c_nationkey < 10 THEN '0-9' WHEN c_nationkey < 20 THEN '10-19' ELSE '20+' END AS left_bin,
       CASE WHEN c_nationkey <= 17 THEN '0-17' ELSE '18+' END AS band
FROM customer""")
def clip_and_bins(spark, folder):
    n = F.col("c_nationkey")
    return read_table(spark, folder, "customer").select(
        "c_custkey",
        N.clip(F.col("c_acctbal"), 1000, 8000).alias("clipped"),
        N.null_out_of_range(n, 3, 20).alias("kept"),
        N.cut(n, [0, 10, 20, 30], True, ["0-10", "10-20", "20-30"]).alias("right_bin"),
        N.cut(n, [0, 10, 20, 60], False, ["0-9", "10-19", "20+"]).alias("left_bin"),
        N.inclusive_bands(n, [(None, 17, "0-17"), (18, None, "18+")]).alias("band"),
    )


@query("P18", "P29", "F7", sql="""
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Cured' WHEN '2-HIGH' THEN 'Treatment Completed'
            WHEN '3-MEDIUM' THEN 'Lost to Follow-Up' WHEN '4-NOT SPECIFIED' THEN 'Died' END AS outcome,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0
            WHEN '4-NOT SPECIFIED' THEN 0 END AS success,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Cured' WHEN '4-NOT SPECIFIED' THEN 'Died' END AS listed,
       CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' END AS sex,
       CASE o_orderstatus WHEN 'F' THEN 'Regimen 1' WHEN 'P' THEN 'Regimen 2' END AS regimen,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Success' WHEN '4-NOT SPECIFIED' THEN 'Died' ELSE 'Other' END AS outcome_class
FROM orders""")
def map_category(spark, folder):
    raw = pick("o_orderpriority", {
        "1-URGENT": " CURED ", "2-HIGH": "tx completed", "3-MEDIUM": "LTFU", "4-NOT SPECIFIED": "Died",
    }, "unheard of")
    sex = pick("o_orderstatus", {"F": "F ", "O": "male"}, "4")
    regimen = pick("o_orderstatus", {"F": "2HRZE/4HR", "P": " Regimen 2"}, "-")
    outcome = C.map_category(raw, V.OUTCOME)
    return read_table(spark, folder, "orders").select(
        "o_orderkey", outcome.alias("outcome"), C.success_label(outcome).alias("success"),
        C.whitelist(outcome, ["Cured", "Died"]).alias("listed"),
        C.map_category(sex, V.SEX).alias("sex"), C.map_category(regimen, V.REGIMEN).alias("regimen"),
        C.outcome_category(raw).alias("outcome_class"),
    )


@query("P19", "P21", "P22", sql="""
SELECT p_partkey,
       CASE p_type WHEN 'STANDARD' THEN 'Normal' WHEN 'ECONOMY' THEN 'Other' WHEN 'PROMO' THEN 'Suggestive of PTB'
            WHEN 'MEDIUM' THEN 'Suggestive of PTB' WHEN 'LARGE' THEN 'Other' END AS film,
       CASE p_type WHEN 'STANDARD' THEN 'Detected' WHEN 'ECONOMY' THEN 'Not_Detected' WHEN 'PROMO' THEN 'Not_Detected'
            ELSE 'Not_Done' END AS rapid,
       CASE p_type WHEN 'STANDARD' THEN 'Diabetes' WHEN 'ECONOMY' THEN 'Hypertension' WHEN 'PROMO' THEN 'None'
            ELSE 'Other' END AS comorbidity,
       CASE p_type WHEN 'STANDARD' THEN 'Negative' WHEN 'ECONOMY' THEN '2+' WHEN 'PROMO' THEN 'Scanty'
            WHEN 'MEDIUM' THEN 'Not Done' ELSE 'Unknown' END AS grade,
       CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN '10 mm ' || p_name END AS skin_test,
       CASE p_type WHEN 'STANDARD' THEN 'No' ELSE 'Yes' END AS history
FROM part""")
def keyword_bucket(spark, folder):
    film = pick("p_type", {"STANDARD": "Normal chest", "ECONOMY": "abnormal", "PROMO": "suggestive of PTB",
                           "MEDIUM": "Parenchymal lesion", "LARGE": "blurred"})
    rapid = pick("p_type", {"STANDARD": "MTB Detected", "ECONOMY": "MTB not detected", "PROMO": "non-reactive",
                            "MEDIUM": "no result"})
    morbid = pick("p_type", {"STANDARD": "DM type 2", "ECONOMY": "elevated BP", "PROMO": "No known"}, "asthma")
    grade = pick("p_type", {"STANDARD": "0", "ECONOMY": "2+", "PROMO": "(+)", "MEDIUM": "ODT"}, F.col("p_name"))
    skin = pick("p_type", {"STANDARD": F.concat(F.lit("10 mm "), F.col("p_name")),
                           "ECONOMY": F.concat(F.lit("10 mm "), F.col("p_name")), "PROMO": "Opacity left"}, "a mass")
    past = pick("p_type", {"STANDARD": " NO "}, "2019")
    return read_table(spark, folder, "part").select(
        "p_partkey", C.chest_film(film).alias("film"), C.rapid_test(rapid).alias("rapid"),
        C.comorbidity_class(morbid).alias("comorbidity"), C.microscopy_grade(grade).alias("grade"),
        C.null_misplaced(skin).alias("skin_test"), C.prior_history(past).alias("history"),
    )


@query("P20", sql="""
WITH t AS (
  SELECT p_partkey, p_type, array_to_string(list_transform(string_split(p_name, ' '),
           lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part)
SELECT p_partkey,
       CASE p_type WHEN 'STANDARD' THEN 'Diabetes Mellitus, Hypertension, ' || title
            WHEN 'ECONOMY' THEN 'No Known Comorbidity'
            WHEN 'PROMO' THEN 'Diabetic Kidney Disease, Diabetes Mellitus'
            WHEN 'MEDIUM' THEN title || ', Asthma' END AS terms
FROM t""")
def normalize_terms(spark, folder):
    name = F.col("p_name")
    raw = pick("p_type", {
        "STANDARD": F.concat(F.lit("dm; HTN, dm., "), name), "ECONOMY": " None ",
        "PROMO": "diabetic kidney disease. DM", "MEDIUM": F.concat(name, F.lit("; bronchial asthma")),
        "LARGE": " ; ",
    })
    return read_table(spark, folder, "part").select("p_partkey", C.normalize_terms(raw).alias("terms"))


@query("P23", "P26", sql="""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 'Filipino' WHEN o_orderstatus = 'O' THEN 'Korean' END AS nationality,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 41 WHEN 2025 - year(o_orderdate) BETWEEN 0 AND 28 THEN 2025 - year(o_orderdate) END AS INTEGER) AS age
FROM orders""")
def fill_from_second_column(spark, folder):
    first = pick("o_orderstatus", {"F": "filipino "}, "N/A")
    second = pick("o_orderstatus", {"O": "korean"})
    age = F.when(F.col("o_orderstatus") == "F", 41)
    computed = D.age_in_year(F.col("o_orderdate"), F.lit(2025), 0, 28)
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.coalesce(C.nationality(first), C.nationality(second)).alias("nationality"),
        F.coalesce(age, computed).alias("age"),
    )


@query("P24", "P25", "P30", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(l_shipdate) AS INTEGER) AS ship_month,
       CAST(quarter(l_shipdate) AS INTEGER) AS ship_quarter, CAST(dayofyear(l_shipdate) AS INTEGER) AS ship_day_of_year,
       CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Tag-lamig' WHEN month(l_shipdate) <= 5 THEN 'Tag-init'
            ELSE 'Tag-ulan' END AS ship_season,
       CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) <= 5 THEN 'Spring'
            WHEN month(l_shipdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS season_four,
       CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 60
            THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) END AS delay,
       CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS ship_epoch
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def date_parts_and_delay(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    ship = F.col("l_shipdate")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", *D.date_parts(ship, "ship"),
        D.season(F.month(ship), V.SEASON_FOUR).alias("season_four"),
        D.interval_days(F.col("o_orderdate"), ship, 0, 60).alias("delay"),
        D.epoch_day(ship).alias("ship_epoch"),
    )


@query("P27", "S10", sql="""
SELECT p_partkey, p_name, printf('%.1f kg', CAST(p_size AS DOUBLE)) AS weight, round(p_retailprice, 2) AS price
FROM part""")
def readable_export(spark, folder):
    parts = read_table(spark, folder, "part").select(
        "p_partkey", "p_name", F.col("p_size").cast("double").alias("weight"), F.col("p_retailprice").alias("price")
    )
    return readable(parts, units={"weight": "kg"})


@query("P33", "P38", sql="""
SELECT l_orderkey, l_linenumber, l_partkey,
       round(1 / (1 + exp(-(0.8::DOUBLE * (l_quantity / 10 - 2) + 0.1))), 6) AS platt,
       round(1 / (1 + exp(-((l_quantity / 10 - 2) / 1.5::DOUBLE))), 6) AS tempered,
       CASE WHEN l_returnflag = 'R' AND l_quantity >= 25 THEN 'true_failure' WHEN l_returnflag = 'R' THEN 'false_success'
            WHEN l_quantity >= 25 THEN 'false_failure' ELSE 'true_success' END AS kind
FROM lineitem""")
def calibrate_scores(spark, folder):
    logit = F.col("l_quantity") / 10 - 2
    truth = (F.col("l_returnflag") == "R").cast("int")
    guess = (F.col("l_quantity") >= 25).cast("int")
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r6(N.calibrate(logit, platt=(0.8, 0.1))).alias("platt"),
        r6(N.calibrate(logit, temperature=1.5)).alias("tempered"),
        N.prediction_type(truth, guess).alias("kind"),
    )


@query("P36", sql="""
SELECT o_orderkey,
       E'Patient profile:\\n- Id: ' || o_orderkey ||
       CASE WHEN o_orderstatus <> 'P' THEN E'\\n- Status: ' || o_orderstatus ELSE '' END ||
       E'\\n\\nPredicted failure probability: ' || CASE o_orderstatus WHEN 'F' THEN '73' ELSE '21' END ||
       E'%\\n\\nTop contributing factors:\\n' ||
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Contributing factors are withheld. Name the three to five factors you believe drove this prediction and reason from them.'
            ELSE '- Age (patient value: ' || o_orderstatus || E'): +12.5% impact (increases failure risk)\\n- Body Weight: -3.0% impact (decreases failure risk)' END AS prompt
FROM orders""")
def render_prompts(spark, folder):
    factors = F.array(
        F.struct(F.lit("Age").alias("feature"), F.lit(0.125).alias("delta")),
        F.struct(F.lit("Body Weight").alias("feature"), F.lit(-0.03).alias("delta")),
    )
    status = F.col("o_orderstatus")
    text = T.prompt_text(
        [("Id", F.col("o_orderkey")), ("Status", F.when(status != "P", status))],
        F.when(status == "F", 0.73).otherwise(0.21), factors,
        blind=F.col("o_orderpriority") == "5-LOW", values=F.create_map(F.lit("Age"), status),
    )
    return read_table(spark, folder, "orders").select("o_orderkey", text.alias("prompt"))


@query("P37", sql="""
SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, text)) AS key FROM documents""")
def lineage_keys(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id", T.lineage_key(*[F.col(c) for c in ("doc_id", "lang", "source", "text")]).alias("key")
    )


@query("P39", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_payload(spark, folder):
    return read_table(spark, folder, "events").select("event_id", json_field(F.col("props"), "$.k", "int").alias("k"))


@query("P35", "E5", sql="""
WITH n AS (
  SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'M' || l_linenumber || '_weight'
                  WHEN 'N' THEN 'trend_pct_adherence' ELSE 'sex_Male' END AS feature FROM lineitem)
SELECT feature, CASE WHEN feature LIKE 'M%' THEN 'Body_Weight' WHEN feature LIKE 'trend%' THEN 'Treatment_Adherence'
       ELSE 'Sex' END AS "group", false AS unmapped FROM n""")
def feature_groups(spark, folder):
    from panelwright.operators.attribution import group_table

    number = F.col("l_linenumber").cast("string")
    name = pick("l_returnflag", {"A": F.concat(F.lit("M"), number, F.lit("_weight")), "N": "trend_pct_adherence"}, "sex_Male")
    return group_table(read_table(spark, folder, "lineitem").select(name.alias("feature")).distinct())


@query("P1", "P2", sql="""
SELECT c_custkey AS m0_pct_adherence, c_name AS name_of_treatment_unit, c_nationkey AS xpert_mtb_rif,
       c_mktsegment AS nationality_raw FROM customer""")
def standardize_columns(spark, folder):
    raw = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("M0_%Adherence"), F.col("c_name").alias(" Name of  Treatment Unit:"),
        F.col("c_nationkey").alias("Xpert MTB/RIF"), F.col("c_mktsegment").alias("Nationality"),
    )
    return T.standardize_columns(raw)


@query("F1", "F2", "F3", "F5", "F8", sql=f"""
WITH {CUSTOMER_STATIC}
SELECT entity_id, outcome, nation FROM static
WHERE outcome IN ('Cured', 'Treatment Completed', 'Died') AND nation BETWEEN 2 AND 22
  AND segment NOT LIKE '%ITURE' AND segment NOT LIKE 'HOUSE%'""")
def label_and_range_filters(spark, folder):
    static = customer_static(spark, folder).withColumns({
        "is_missing_outcome": F.col("outcome").isNull().cast("int"), "facility": F.lit("x"),
    })
    kept = observed_labels(static).filter(
        F.col("outcome").isin("Cured", "Treatment Completed", "Died") & F.col("nation").between(2, 22)
        & ~F.col("segment").endswith("ITURE") & ~F.col("segment").startswith("HOUSE")
    )
    return drop_policy(kept).select("entity_id", "outcome", "nation")


@query("F6", "S5", "S6", "S7", sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 AND o_orderstatus <> 'F'""")
def scan_cleanup(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"),
        pick("o_orderpriority", {"5-LOW": "  "}, F.col("o_orderpriority")).alias("priority"),
        pick("o_orderstatus", {"F": " status "}, F.col("o_orderstatus")).alias("status"),
    )
    kept = drop_repeated_headers(orders, "status").filter(F.col("year").between(1996, 2000))
    return kept.select("o_orderkey", P.blank_to_null(F.col("priority")).alias("priority"))


@query("S8", "S9", "U1", sql="""
SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment, 'supplier' AS source_file FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'customer' FROM customer""")
def union_by_name(spark, folder):
    a = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source_file")
    )
    b = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("source_file"),
    )
    return a.unionByName(b, allowMissingColumns=True)


@query("U2", "U3", "J9", sql="""
SELECT DISTINCT p_brand, p_type FROM part
WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 45 INTERSECT SELECT p_type FROM part WHERE p_size < 5)""")
def distinct_pairs(spark, folder):
    parts = read_table(spark, folder, "part")
    big = parts.filter("p_size > 45").select("p_type")
    small = parts.filter("p_size < 5").select("p_type")
    shared = big.intersect(small)
    return parts.select("p_brand", "p_type").dropDuplicates().join(shared, "p_type", "left_semi")
