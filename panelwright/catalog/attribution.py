"""Attribution and explanation-scoring queries."""

from pyspark.sql import functions as F

from panelwright import fixed_values as V
from panelwright.catalog.inputs import ATTRIBUTIONS, attributions, r6
from panelwright.catalog.registry import query
from panelwright.operators import attribution as A, explain as X
from panelwright.sources import sinks
from panelwright.sources.tables import read_table

#: Two spellings of the feature that each line number stands for.
_SPOKEN = (
    ("Treatment Adherence", "treatment adherence"), ("Body Weight", "BODY WEIGHT"), ("Age", "age"),
    ("Xpert Result", "Xpert MTB/RIF"), ("Missed Doses", "missed doses"), ("Smear Result", "Smear/TB Lamp"),
    ("Vital Signs", "vital signs"),
)
_ADVERBS = ("strongly", "moderately", "slightly")
_VERBS = {"A": "raises", "N": "lowers", "R": "has a mixed effect on"}
_SILENT = "No factor was named."


def explanations(spark, folder):
    """One explanation per order: a sentence per line, and after the first the whole document of the order's number.

    A sentence names the line's feature in one of two spellings, with an adverb (every fourth
    supplier has none) and a direction by return flag; equal sentences of a line number stand
    once. Orders without priority name no feature. Orders without lines and document have no text.
    """
    from panelwright.catalog.cleaning import pick

    spellings = F.array(*[F.array(*[F.lit(w) for w in pair]) for pair in _SPOKEN])
    name = F.get(F.get(spellings, F.col("l_linenumber") - 1), (F.col("l_partkey") % 2).cast("int"))
    adverb = F.get(F.array(*[F.lit(w) for w in _ADVERBS]), (F.col("l_suppkey") % 4).cast("int"))
    sentence = F.concat_ws(" ", name, adverb, pick("l_returnflag", _VERBS), F.lit("the risk."))
    said = F.collect_set(F.struct("l_linenumber", sentence.alias("said")))  # at most 168 a case
    stated = read_table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.array_sort(said)["said"].alias("said"))
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("case_id"), "text")
    cases = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderpriority")
    silent = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    rest = F.when(~silent & (F.size("said") > 1), F.array_join(F.slice("said", 2, 168), " "))
    whole = F.concat_ws("\n", F.when(silent, _SILENT).otherwise(F.get("said", F.lit(0))), "text", rest)
    told = cases.join(stated, "case_id", "left").join(texts, "case_id", "left")
    return told.select("case_id", F.nullif(whole, F.lit("")).alias("explanation"))


def _listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEXTS = f"""
said AS (
  SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS n, concat_ws(' ',
         list_extract(list_extract([{", ".join(_listed(pair) for pair in _SPOKEN)}], l_linenumber), 1 + l_partkey % 2),
         list_extract({_listed(_ADVERBS)}, 1 + l_suppkey % 4),
         CASE l_returnflag {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VERBS.items())} END, 'the risk.') AS said FROM lineitem),
places AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n, said) AS place FROM said),
stated AS (SELECT case_id, max(said) FILTER (WHERE place = 1) AS opening,
                  string_agg(said, ' ' ORDER BY place) FILTER (WHERE place > 1) AS rest FROM places GROUP BY 1),
texts AS (SELECT o_orderkey AS case_id, nullif(concat_ws(chr(10),
                 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '{_SILENT}' ELSE opening END, text,
                 CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN rest END), '') AS explanation
          FROM orders LEFT JOIN stated ON case_id = o_orderkey LEFT JOIN documents ON doc_id = o_orderkey)"""


def _claims_sql(source, vocabulary, increase, decrease, mixed, magnitudes, around=V.CLAIM_CONTEXT_CHARS):
    """Claims in ``source`` (case_id, explanation) as a table expression ``claims``."""

    def has(words):
        edge = "[^\\p{L}\\p{N}_]"
        return f"regexp_matches(c, '(^|{edge})(?:{'|'.join(words)})($|{edge})')"

    sizes = " ".join(f"WHEN {has([word])} THEN '{label}'" for word, label in magnitudes)
    return f"""
vocabulary(feature) AS (VALUES {", ".join(f"('{w}')" for w in vocabulary)}),
lowered AS (SELECT case_id, lower(explanation) AS t FROM {source}),
mentions AS (SELECT case_id, feature, strpos(t, lower(feature)) AS position, t FROM lowered JOIN vocabulary ON contains(t, lower(feature))),
contexts AS (SELECT case_id, feature, position, substr(t, GREATEST(1, position - {around}),
             position + length(feature) + {around} - GREATEST(1, position - {around})) AS c FROM mentions),
claims AS (
  SELECT case_id, feature, CAST(position AS INTEGER) AS position,
         CASE WHEN {has(increase)} THEN 'increase' WHEN {has(decrease)} THEN 'decrease' WHEN {has(mixed)} THEN 'mixed' END AS direction,
         CASE {sizes} ELSE 'unspecified' END AS magnitude
  FROM contexts WHERE {has([*increase, *decrease, *mixed])})"""


_CLAIMS = f"""{_TEXTS},
{_claims_sql("texts", V.KNOWN_FEATURES, V.INCREASE_PHRASES, V.DECREASE_PHRASES, V.MIXED_PHRASES, V.MAGNITUDE_WORDS)}"""


@query("E7", sql=f"WITH {_CLAIMS} SELECT * FROM claims")
def explanation_claims(spark, folder):
    return X.claims(explanations(spark, folder), "explanation", "case_id")


_PROSE = dict(
    vocabulary=["that", "and", "Age", "Sex", "Dates", "Height"], increase=["higher", "the", "increase"],
    decrease=["lower", "in", "decrease"], mixed=["of"], magnitudes=[("st", "strong")],
)


@query("E7", sql=f"""
WITH texts AS (SELECT doc_id AS case_id, text AS explanation FROM documents), {_claims_sql("texts", **_PROSE)}
SELECT case_id AS doc_id, feature, position, direction, magnitude FROM claims""")
def claims_in_documents(spark, folder):
    return X.claims(read_table(spark, folder, "documents"), "text", "doc_id", **_PROSE)


@query("E7", "A22", sql=f"""
WITH {_CLAIMS}, n AS (SELECT case_id, count(*) AS n FROM claims GROUP BY 1)
SELECT case_id, CASE WHEN n IS NULL THEN 'parse_failed' ELSE 'ok' END AS status,
       CAST(coalesce(n, 0) AS BIGINT) AS claims, round(coalesce(n, 0) / {len(V.KNOWN_FEATURES)}.0::DOUBLE, 6) AS coverage
FROM texts LEFT JOIN n USING (case_id)""")
def claim_coverage(spark, folder):
    cases = explanations(spark, folder)
    table = X.coverage(X.claims(cases, "explanation", "case_id"), cases, "case_id")
    return table.withColumn("coverage", r6("coverage"))


_TRUTH = f"""
{ATTRIBUTIONS}, ranked AS (
  SELECT case_id, feature, value, abs(value) AS abs_value,
         row_number() OVER (PARTITION BY case_id ORDER BY abs(value) DESC, feature) AS rank,
         max(abs(value)) OVER (PARTITION BY case_id) AS top FROM attributions),
truth AS (
  SELECT case_id, feature, CASE WHEN value >= 0 THEN 'increase' ELSE 'decrease' END AS sign, abs_value, CAST(rank AS INTEGER) AS rank,
         CASE WHEN abs_value >= 0.30::DOUBLE * top THEN 'strong' ELSE 'moderate' END AS magnitude_band FROM ranked WHERE rank <= 5)"""


@query("E6", "W8", "W9", sql=f"WITH {_TRUTH} SELECT * FROM truth")
def truth_rows(spark, folder):
    return X.truth_rows(attributions(spark, folder))


_NAMES = {c.lower().replace("_", " "): c for c in V.CANONICAL_FEATURES} | V.FEATURE_ALIASES
_SCORES = f"""
{_TRUTH}, {_CLAIMS}, names(spoken, canonical) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items())}),
called AS (SELECT case_id, coalesce(canonical, feature) AS feature, direction, magnitude, position
           FROM claims LEFT JOIN names ON spoken = lower(replace(feature, '_', ' '))),
named AS (SELECT * FROM called QUALIFY row_number() OVER (PARTITION BY case_id, feature ORDER BY position DESC) = 1),
b AS (SELECT coalesce(t.case_id, c.case_id) AS case_id, t.sign, t.magnitude_band, c.direction, c.magnitude
      FROM truth t FULL JOIN named c ON c.case_id = t.case_id AND c.feature = t.feature),
n AS (SELECT case_id, count(sign)::DOUBLE AS nt, count(direction)::DOUBLE AS nc,
             (count(*) FILTER (WHERE sign IS NOT NULL AND direction IS NOT NULL))::DOUBLE AS hit,
             (count(*) FILTER (WHERE sign = direction))::DOUBLE AS sg, (count(*) FILTER (WHERE magnitude_band = magnitude))::DOUBLE AS mg
      FROM b GROUP BY 1),
s AS (SELECT o_orderkey AS case_id,
             CASE WHEN coalesce(nt, 0) + coalesce(nc, 0) = 0 THEN 1.0::DOUBLE ELSE 2 * hit / (nt + nc) END AS f,
             CASE WHEN coalesce(nt, 0) + coalesce(nc, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(sg / nullif(hit, 0), 0) END AS sa,
             CASE WHEN coalesce(nt, 0) + coalesce(nc, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(mg / nullif(hit, 0), 0) END AS ma
      FROM orders LEFT JOIN n ON n.case_id = o_orderkey),
scores AS (SELECT case_id, round(f, 6) AS feature_f1, round(sa, 6) AS sign_accuracy, round(ma, 6) AS magnitude_accuracy,
             round(0.45::DOUBLE * f + 0.35::DOUBLE * sa + 0.20::DOUBLE * ma, 6) AS composite, f, sa, ma FROM s)"""


def _scored(spark, folder):
    cases = explanations(spark, folder)
    claimed = X.claims(cases, "explanation", "case_id").withColumn("feature", X.canonical_name(F.col("feature")))
    return X.score_cases(X.truth_rows(attributions(spark, folder)), claimed, cases)


@query("E8", "E9", "J7", sql=f"""
WITH {_SCORES}
SELECT case_id, feature_f1, sign_accuracy, magnitude_accuracy, composite,
       f >= 0.6 AND sa >= 0.6 AND ma >= 0.5 AND composite >= 0.6 AS passed,
       concat_ws(',', CASE WHEN f < 0.6 THEN 'low_feature_f1' END, CASE WHEN sa < 0.6 THEN 'low_sign_accuracy' END,
                 CASE WHEN ma < 0.5 THEN 'low_magnitude_accuracy' END, CASE WHEN composite < 0.6 THEN 'low_composite' END) AS failure_tags
FROM scores""")
def score_cases(spark, folder):
    return _scored(spark, folder).withColumn("failure_tags", F.array_join("failure_tags", ","))


@query("A22", sql=f"""
WITH {_SCORES}, p AS (SELECT f >= 0.6 AND sa >= 0.6 AND ma >= 0.5 AND composite >= 0.6 AS passed FROM scores)
SELECT count(*) AS total_cases, count(*) FILTER (WHERE passed) AS passed,
       round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 6) AS pass_rate FROM p""")
def run_summary(spark, folder):
    return X.run_summary(_scored(spark, folder))


@query("E10", "J8", sql="""
WITH b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1000000 AS v FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
c AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1000000 AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT coalesce(b.metric, c.metric) || '_delta' AS metric, round(coalesce(c.v, 0) - coalesce(b.v, 0), 6) AS delta FROM b FULL JOIN c ON b.metric = c.metric""")
def compare_runs(spark, folder):
    orders = read_table(spark, folder, "orders")
    value = (F.avg("o_totalprice") / 1000000).alias("value")
    base = orders.filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("metric")).agg(value)
    now = orders.filter("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'").groupBy(
        F.col("o_orderpriority").alias("metric")
    ).agg(value)
    return X.compare_runs(base, now)


def _groups(df):
    from panelwright.catalog.cleaning import pick

    group = pick("feature", {"Age": "Profile", "Body_Weight": "Profile", "Vital_Signs": "Profile",
                             "Treatment_Adherence": "Dosing", "Missed_Doses": "Dosing"}, "Laboratory")
    return df.select("feature").distinct().select("feature", group.alias("group"))


_ROLL = f"""
{ATTRIBUTIONS}, g AS (
  SELECT case_id, CASE WHEN feature IN ('Age', 'Body_Weight', 'Vital_Signs') THEN 'Profile'
         WHEN feature IN ('Treatment_Adherence', 'Missed_Doses') THEN 'Dosing' ELSE 'Laboratory' END AS "group", value FROM attributions),
rolled AS (SELECT case_id, "group", round(sum(value), 5) + 0.0::DOUBLE AS signed_sum, round(sum(abs(value)), 5) AS abs_sum, count(*) AS members,
       CASE WHEN sum(value) > 1e-6 THEN '+' WHEN sum(value) < -1e-6 THEN '-' ELSE 'mixed' END AS sign FROM g GROUP BY 1, 2)"""


@query("E4", "A19", "J6", sql=f"WITH {_ROLL} SELECT * FROM rolled")
def attribution_roll_up(spark, folder):
    rows = attributions(spark, folder)
    table = A.roll_up(rows, _groups(rows))
    return table.withColumns({"signed_sum": r6("signed_sum", 5), "abs_sum": r6("abs_sum", 5)})


@query("E4", "O2", sql=f"""
WITH {_ROLL}, r AS (SELECT case_id, "group", abs_sum, row_number() OVER (PARTITION BY case_id ORDER BY abs_sum DESC, "group") AS rank FROM rolled)
SELECT case_id, "group", abs_sum, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def top_attribution_groups(spark, folder):
    rows = attributions(spark, folder)
    rolled = A.roll_up(rows, _groups(rows)).withColumn("abs_sum", r6("abs_sum", 5))
    return A.top_groups(rolled, k=2).select("case_id", "group", "abs_sum", "rank")


@query("J6", "U3", sql=f"""
WITH {ATTRIBUTIONS} SELECT DISTINCT feature FROM attributions WHERE feature NOT IN ('Age', 'Body_Weight')""")
def uncovered_features(spark, folder):
    rows = attributions(spark, folder)
    return A.uncovered(rows, _groups(rows).filter(F.col("feature").isin("Age", "Body_Weight")))


@query("E13", "W12", sql="""
WITH i AS (SELECT CASE WHEN l_linenumber = 1 THEN 'M1_weight' WHEN l_linenumber = 2 THEN 'mean_weight' WHEN l_linenumber = 3 THEN 'trend_weight'
                  WHEN l_linenumber = 4 THEN 'latest_weight' ELSE 'age' END AS feature, l_quantity AS q FROM lineitem),
f AS (SELECT CASE WHEN feature LIKE 'M1%' THEN 'raw_step' WHEN feature LIKE 'mean%' THEN 'aggregate' WHEN feature LIKE 'trend%' THEN 'trend'
             WHEN feature LIKE 'latest%' THEN 'latest' ELSE 'static' END AS family, sum(q) AS importance FROM i GROUP BY 1)
SELECT family, importance, round(importance / (SELECT sum(importance) FROM f), 6) AS share FROM f""")
def family_importance(spark, folder):
    n = F.col("l_linenumber")
    name = F.when(n == 1, "M1_weight").when(n == 2, "mean_weight").when(n == 3, "trend_weight").when(
        n == 4, "latest_weight"
    ).otherwise("age")
    table = read_table(spark, folder, "lineitem").select(name.alias("feature"), F.col("l_quantity").alias("importance"))
    return A.family_importance(table).withColumn("share", r6("share"))


@query("E11", sql=f"""
WITH {ATTRIBUTIONS}, {_CLAIMS}, a AS (SELECT DISTINCT case_id FROM attributions), k AS (SELECT DISTINCT case_id FROM claims)
SELECT t.case_id, concat_ws(',', CASE WHEN explanation IS NULL THEN 'missing_explanation' END,
       CASE WHEN a.case_id IS NULL THEN 'missing_attributions' END,
       CASE WHEN trim(explanation) <> '' AND k.case_id IS NULL THEN 'no_claims' END) AS issues
FROM texts t LEFT JOIN a USING (case_id) LEFT JOIN k ON k.case_id = t.case_id""")
def case_validation(spark, folder):
    cases = explanations(spark, folder)
    maps = attributions(spark, folder).groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("attributions")
    )
    claimed = X.claims(cases, "explanation", "case_id")
    table = X.case_issues(cases.join(maps, "case_id", "left"), claimed)
    return table.withColumn("issues", F.array_join("issues", ","))


@query("E12", "S11", sql="SELECT 'sighted' AS condition, count(*) AS cases, '5' AS top_k FROM orders")
def case_documents(spark, folder):
    rows = attributions(spark, folder)
    documents = sinks.case_documents(explanations(spark, folder), A.roll_up(rows, _groups(rows)), "sighted")
    manifest = sinks.run_manifest(documents, {"top_k": "5"})
    return manifest.select("condition", "cases", F.col("settings")["top_k"].alias("top_k"))


@query("E12", "S11", sql=f"""
WITH {_ROLL}, {_TEXTS},
shown AS (SELECT case_id, string_agg("group" || ' ' || CAST(round(signed_sum * 1e5)::BIGINT AS VARCHAR), ', ' ORDER BY "group") AS sums,
             string_agg("group" || ' ' || sign || members, ', ' ORDER BY "group") AS details FROM rolled GROUP BY 1)
SELECT case_id, md5(explanation) AS explanation, 'sighted' AS condition, 12 AS month_of_prediction, sums, details
FROM texts LEFT JOIN shown USING (case_id)""")
def case_document_rows(spark, folder):
    """What each case document holds: text digest, signed sums per group (in 1e-5) and the roll-up beside them."""
    rows = attributions(spark, folder)
    rolled = A.roll_up(rows, _groups(rows)).withColumn("signed_sum", r6("signed_sum", 5))
    documents = sinks.case_documents(explanations(spark, folder), rolled, "sighted")
    scaled = lambda v: F.round(v * 1e5).cast("long").cast("string")
    sums = F.transform(F.map_entries("shap_values"), lambda e: F.concat(e["key"], F.lit(" "), scaled(e["value"])))
    details = F.transform("shap_metadata", lambda m: F.concat(m["group"], F.lit(" "), m["sign"], m["members"].cast("string")))
    return documents.select(
        "case_id", F.md5("explanation").alias("explanation"), "condition", "month_of_prediction",
        F.array_join(sums, ", ").alias("sums"), F.array_join(details, ", ").alias("details"))
