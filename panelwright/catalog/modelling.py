"""Model, importance and resampling queries. Fits differ between engines, so most of these
have no SQL side; tests check their properties instead."""

from pyspark.sql import functions as F

from panelwright.catalog.inputs import (
    CUSTOMER_STATIC, EVENT_PANEL, METRICS, ORDER_PANEL, customer_static, event_panel, order_panel, r6,
)
from panelwright.catalog.registry import query
from panelwright.operators import attribution as A, models as M, resample as R
from panelwright.operators.evaluate import per_step_evaluation, rank_metrics
from panelwright.operators.features import features_at_step as at_step, stratified_split, step_features as steps
from panelwright.operators.missing.fill import fill_central
from panelwright.operators.panel import panel_to_wide
from panelwright.operators.stats import scale_fit, standardize
from panelwright.session import cut_lineage, fit_rows
from panelwright.sources.tables import read_table

_DOC = ["length", "lang_en", "lang_de", "lang_fr", "words", "lines"]


def document_features(spark, folder):
    """Labelled documents with plain text features, written once: fits and scorings pass over
    a few numbers per document many times and must not read the texts each time."""
    documents = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels")
    flags = [(F.col("lang") == x).cast("double").alias(f"lang_{x}") for x in ("en", "de", "fr")]
    rows = documents.join(labels, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.log1p("n_chars").alias("length"), *flags,
        F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
    )
    return cut_lineage(rows)


def _split_documents(spark, folder):
    rows = document_features(spark, folder)
    split = stratified_split(rows, "doc_id", "label").select("doc_id", "split")
    return rows.join(split, "doc_id")


def _outcome(spark, folder, kind, **options):
    rows = _split_documents(spark, folder)
    train = rows.filter("split = 'train'")
    if kind == "gbt":  # boosting stops once the validation part no longer gains
        train = rows.filter("split <> 'test'").withColumn("_held", F.col("split") == "validation")
        options["validationIndicatorCol"] = "_held"
    model = M.fit_classifier(train, _DOC, "label", kind, **options)
    return M.score(model, rows).select("doc_id", "split", "label", r6("probability").alias("probability"))


@query("R9", "R8", "R17")
def gbt_outcome(spark, folder):
    return _outcome(spark, folder, "gbt", maxIter=200)


@query("R9", "R17")
def forest_outcome(spark, folder):
    return _outcome(spark, folder, "forest", numTrees=200)


@query("R9", "R17")
def logistic_outcome(spark, folder):
    return _outcome(spark, folder, "logistic")


@query("R9", "R17")
def svm_outcome(spark, folder):
    return _outcome(spark, folder, "svm")


@query("R9", "R11")
def outcome_auc(spark, folder):
    return rank_metrics(_outcome(spark, folder, "logistic"), "label", "probability", ["split"])


@query("R17", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, round(1 / (1 + exp(-(0.3 * coalesce(missed, 0) - 0.2 * coalesce(doses, 0)))), 6) AS probability FROM panel""")
def foreign_model_scores(spark, folder):
    """A model that is not Spark's: any callable over a feature matrix, loaded once per task."""

    def load():
        import numpy as np

        weights = np.array([0.3, -0.2])
        return lambda matrix: 1 / (1 + np.exp(-(matrix @ weights)))

    panel = event_panel(spark, folder).select("entity_id", "step", "missed", "doses").fillna(0.0)
    scored = M.score_foreign(panel, load, ["missed", "doses"])
    return scored.select("entity_id", "step", r6("probability").alias("probability"))


@query("R16")
def calibrated_documents(spark, folder):
    scored = _outcome(spark, folder, "logistic")
    scored = scored.withColumn("logit", M.logit_of(F.col("probability")))
    held = scored.filter("split = 'validation'")
    a, b = M.fit_platt(held, "logit", "label")
    t = M.fit_temperature(held, "logit", "label")
    from panelwright.functions.numeric import calibrate

    return scored.select(
        "doc_id", r6(calibrate(F.col("logit"), platt=(a, b))).alias("platt"),
        r6(calibrate(F.col("logit"), temperature=t)).alias("tempered"),
    )


@query("R18", "R7", "T-6")
def counterfactual_gate(spark, folder):
    """Does a model fitted on the panel raise the risk when doses stop?"""
    names = ["doses", "missed", "adherence", "smear"]
    rows = event_panel(spark, folder).select("entity_id", "step", *names).fillna(0.0).withColumn(
        "label", (F.col("missed") > F.col("doses")).cast("int")
    )
    fit = scale_fit(rows, names)
    model = M.fit_classifier(standardize(rows, fit, names), names, "label", "logistic")
    templates = M.template_rows(
        rows, names,
        {"base": {}, "low": {"doses": 10, "missed": 0, "adherence": 1.0, "smear": 0},
         "high": {"doses": 1, "missed": 9, "adherence": 0.1, "smear": 1}},
        fit=fit,
    )
    return M.counterfactual_gate(M.score(model, templates), "probability", min_high=0.5, max_low=0.5)


_STEP_SQL = ", ".join(
    f"coalesce(max(CASE WHEN step = {i} THEN doses END) OVER w, 0) AS M{i}_doses" for i in range(13)
)


@query("R1", "W5", "W6", "X6", sql=f"""
WITH {EVENT_PANEL}
SELECT entity_id, step, {_STEP_SQL}, round(avg(coalesce(doses, 0)) OVER w, 6) AS mean_doses,
       round(stddev_pop(coalesce(doses, 0)) OVER w, 6) AS std_doses, min(coalesce(doses, 0)) OVER w AS min_doses,
       max(coalesce(doses, 0)) OVER w AS max_doses,
       round(CASE WHEN stddev_pop(coalesce(doses, 0)) OVER w > 1e-8 THEN coalesce(regr_slope(coalesce(doses, 0), step) OVER w, 0) ELSE 0 END, 6) + 0.0::DOUBLE AS trend_doses,
       coalesce(doses, 0) AS latest_doses, step AS months_available
FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def step_features(spark, folder):
    table = steps(event_panel(spark, folder), ["doses"], "entity_id")
    return table.withColumns({c: r6(c) for c in ("mean_doses", "std_doses", "trend_doses")})


def _at_step_sql(m):
    return ", ".join([
        *[f"max(CASE WHEN step = {i} THEN {m} END) AS M{i}_{m}" for i in range(7)],
        f"round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}",
        f"round(CASE WHEN stddev_pop({m}) > 1e-8 THEN regr_slope({m}, step) ELSE 0 END, 6) + 0.0::DOUBLE AS trend_{m}",
        f"max(CASE WHEN step = 6 THEN {m} END) AS latest_{m}",
    ])


@query("R1", "J1", sql=f"""
WITH {ORDER_PANEL}, z AS (SELECT entity_id, step, coalesce(n_orders, 0) AS n_orders, coalesce(urgent, 0) AS urgent FROM order_panel WHERE step <= 6),
f AS (SELECT entity_id, {_at_step_sql("n_orders")}, {_at_step_sql("urgent")}, max(step) AS months_available FROM z GROUP BY 1)
SELECT c_custkey AS entity_id, CAST(c_nationkey AS DOUBLE) AS nation, f.* EXCLUDE (entity_id) FROM customer LEFT JOIN f ON f.entity_id = c_custkey""")
def features_at_step(spark, folder):
    static = customer_static(spark, folder).select("entity_id", "nation")
    table = at_step(order_panel(spark, folder), static, ["n_orders", "urgent"], "entity_id", 6)
    noisy = [c for c in table.columns if c.startswith(("mean_", "std_", "trend_"))]
    return table.withColumns({c: r6(c) for c in noisy})


@query("R13", "R17", "R1")
def panel_model_per_step(spark, folder):
    """Fit on training entities at every step, evaluate the held-out ones step by step."""
    features = steps(event_panel(spark, folder), list(METRICS), "entity_id")
    names = [c for c in features.columns if c.startswith(("mean_", "std_", "trend_", "latest_", "months_"))]
    features = cut_lineage(features.select("entity_id", "step", *names))
    label = features.groupBy("entity_id").agg((F.sum("latest_missed") > F.lit(16)).cast("int").alias("label"))
    split = stratified_split(label, "entity_id", "label").select("entity_id", "split")
    rows = features.join(label, "entity_id").join(split, "entity_id")
    rows = fit_rows(rows.select("entity_id", "step", "label", "split", *names), spark.sparkContext.defaultParallelism)
    model = M.fit_classifier(rows.filter("split = 'train'"), names, "label", "forest", numTrees=200, cacheNodeIds=True)
    scored = M.score(model, rows.filter("split = 'test'")).select("step", "label", "probability")
    return per_step_evaluation(cut_lineage(scored), "label", "probability", 0.5)


@query("E1")
def permutation_importance(spark, folder):
    rows = document_features(spark, folder)
    model = M.fit_classifier(rows, _DOC, "label", "logistic")
    return A.permutation_importance(
        rows, "doc_id", "label", _DOC, lambda df: M.score(model, df)
    )


@query("E2")
def occlusion(spark, folder):
    rows = document_features(spark, folder)
    fit = scale_fit(rows, _DOC)
    scaled = standardize(rows, fit, _DOC)
    model = M.fit_classifier(scaled, _DOC, "label", "logistic")
    groups = {"size": ["length", "words", "lines"], "language": ["lang_en", "lang_de", "lang_fr"]}
    return A.occlusion(scaled, "doc_id", groups, lambda df: M.score(model, df))


@query("E3", "E2", sql=f"""
WITH {EVENT_PANEL}, z AS (
  SELECT entity_id * 100 + step AS row_key, coalesce(doses, 0) AS doses, coalesce(missed, 0) AS missed FROM panel),
p AS (SELECT row_key, doses, missed, 1 / (1 + exp(-(0.3 * missed - 0.2 * doses))) AS base FROM z),
d AS (SELECT row_key, unnest(['doses', 'missed']) AS "group",
             unnest([base - 1 / (1 + exp(-(0.3 * missed))), base - 1 / (1 + exp(0.2 * doses))]) AS raw FROM p)
SELECT row_key, "group", round(abs(raw), 6) AS delta, CASE WHEN round(raw, 9) >= 0 THEN 'risk' ELSE 'protective' END AS direction FROM d""")
def single_feature_masking(spark, folder):
    panel = event_panel(spark, folder).select(
        (F.col("entity_id") * 100 + F.col("step")).alias("row_key"),
        F.coalesce("doses", F.lit(0.0)).alias("doses"), F.coalesce("missed", F.lit(0.0)).alias("missed"),
    )

    def scorer(df):
        return df.withColumn("probability", 1 / (1 + F.exp(-(0.3 * F.col("missed") - 0.2 * F.col("doses")))))

    table = A.occlusion(panel, "row_key", {"doses": ["doses"], "missed": ["missed"]}, scorer)
    return table.withColumn("delta", r6("delta"))


def _vectors(spark, folder):
    rows = read_table(spark, folder, "embeddings")
    return rows.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


@query("R4", "J12", sql="""
WITH n AS (SELECT count(*) FILTER (WHERE label = 0) AS small, count(*) FILTER (WHERE label <> 0) AS large FROM embeddings)
SELECT 0 AS label, false AS synthetic, large AS rows FROM n UNION ALL SELECT 1, false, small FROM n
UNION ALL SELECT 1, true, large - small FROM n""")
def smote_balance(spark, folder):
    grown = R.interpolate_minority(_vectors(spark, folder), "embedding", "label", "vec_id", minority=1)
    return grown.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("rows"))


def _millionths(vector):
    return F.array_join(F.transform(vector, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")


_DRAW = "(('0x' || substr(md5(concat_ws(':', id, draw, {seed})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("R4", "J12", sql=f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0),
n AS (SELECT count(*) FILTER (WHERE label = 0) AS have, count(*) FILTER (WHERE label <> 0) - count(*) FILTER (WHERE label = 0) AS need,
             least(5, count(*) FILTER (WHERE label = 0) - 1) AS k, least(0, min(vec_id)) AS lowest FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', id, 42)), 1, 15))::BIGINT, id) AS r FROM v),
d AS (SELECT r.*, n.*, unnest(range(1, need // have + CASE WHEN r <= need % have THEN 2 ELSE 1 END)) AS draw FROM r, n),
near AS (
  SELECT a.id, b.e AS other, row_number() OVER (PARTITION BY a.id ORDER BY
    list_sum(list_transform(list_zip(a.e, b.e), lambda p: pow(p[1] - p[2], 2))), b.id) AS place FROM v a JOIN v b ON a.id <> b.id),
p AS (SELECT *, floor({_DRAW.format(seed=42)} * k)::BIGINT + 1 AS place, {_DRAW.format(seed=49)} AS u FROM d)
SELECT lowest - ((draw - 1) * have + r) AS sample_id,
  array_to_string([round(1e6 * (z[1] + u * (z[2] - z[1])))::BIGINT for z in list_zip(e, other)], ',') AS vec
FROM p JOIN near USING (id, place)""")
def smote_vectors(spark, folder):
    """Every interpolated vector, in millionths, by draws that SQL repeats."""
    grown = R.interpolate_minority(_vectors(spark, folder), "embedding", "label", "vec_id", minority=1)
    return grown.filter("synthetic").select("sample_id", _millionths("vec").alias("vec"))


@query("R5", "J12", sql="""
WITH v AS (SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings),
d AS (
  SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY
           list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))), b.vec_id) AS n
  FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, label FROM d WHERE n <= 3 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE other <> label) = 0""")
def enn_clean(spark, folder):
    return R.edited_neighbours(_vectors(spark, folder), "embedding", "label", "vec_id").select("vec_id", "label")


@query("J12", sql="""
WITH d AS (
  SELECT a.vec_id AS qid, b.vec_id AS pid,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rank FROM d)
SELECT qid, pid, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def nearest_neighbours(spark, folder):
    from panelwright.operators.neighbours import nearest_rows

    return nearest_rows(_vectors(spark, folder), "embedding", "vec_id", 3).withColumn("distance", r6("distance"))


@query("R6", sql="""
SELECT vec_id, CAST(copy AS INTEGER) AS copy, 'noise' AS kind FROM embeddings, (SELECT unnest(range(1, 6)) AS copy) WHERE label = 0
UNION ALL SELECT vec_id, CAST(copy AS INTEGER), 'mixup' FROM embeddings, (SELECT unnest(range(1, 3)) AS copy) WHERE label = 0""")
def noise_and_mixup(spark, folder):
    minority = _vectors(spark, folder).filter("label = 1")
    noisy = R.noise_copies(minority, "embedding", "vec_id", static_from=32).select("vec_id", "copy")
    mixed = R.mixup_pairs(minority, "embedding", "vec_id").select(F.col("id").alias("vec_id"), F.col("draw").alias("copy"))
    return noisy.withColumn("kind", F.lit("noise")).unionByName(mixed.withColumn("kind", F.lit("mixup")))


_DRAWN = "(('0x' || substr(md5(concat_ws(':', {key}, {seed})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_MILLIONTHS = "string_agg(CAST(round(1e6 * x)::BIGINT AS VARCHAR), ',' ORDER BY i) AS vec"


@query("R6", sql=f"""
WITH v AS (SELECT vec_id, copy, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(1, 6) AS c(copy), range(64) AS p(i)
           WHERE label = 0 AND i < len(embedding)),
g AS (SELECT vec_id, copy, i, x + CASE WHEN i >= 32 THEN 0.025::DOUBLE ELSE 0.05::DOUBLE END
        * sqrt(-2 * ln(GREATEST({_DRAWN.format(key="vec_id, copy, i", seed=42)}, 1e-300::DOUBLE)))
        * cos(2 * pi() * {_DRAWN.format(key="vec_id, copy, i", seed=1_000_045)}) AS x FROM v)
SELECT vec_id, CAST(copy AS INTEGER) AS copy, {_MILLIONTHS} FROM g GROUP BY 1, 2""")
def noise_vectors(spark, folder):
    """Every jittered vector, in millionths, by draws that SQL repeats."""
    noisy = R.noise_copies(_vectors(spark, folder).filter("label = 1"), "embedding", "vec_id", static_from=32)
    return noisy.select("vec_id", "copy", _millionths("embedding").alias("vec"))


@query("R6", sql=f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0),
r AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', id, 42)), 1, 15))::BIGINT, id) AS r, count(*) OVER () AS n FROM v),
d AS (SELECT *, unnest([1, 2]) AS draw FROM r WHERE n >= 2),
a AS (SELECT *, (r - 1 + floor({_DRAWN.format(key="id, draw", seed=45)} * (n - 1))::BIGINT + 1) % n + 1 AS aim FROM d),
t AS (SELECT id, draw, i, pow({_DRAWN.format(key="id, draw, i", seed=53)}, 2.5) AS x, pow({_DRAWN.format(key="id, draw, i", seed=54)}, 2.5) AS y
      FROM d, range(1, 25) AS tries(i)),
w AS (SELECT id, draw, coalesce(arg_min(x / (x + y), i) FILTER (WHERE x + y <= 1 AND x + y > 0), 0.5) AS weight FROM t GROUP BY 1, 2),
m AS (SELECT a.id, a.draw, weight, o.id AS partner, i, weight * a.e[i] + (1 - weight) * o.e[i] AS x
      FROM a JOIN w USING (id, draw) JOIN r o ON o.r = aim, range(1, 65) AS p(i) WHERE i <= len(a.e))
SELECT id, draw, partner, round(weight, 6) AS weight, {_MILLIONTHS} FROM m GROUP BY 1, 2, 3, 4""")
def mixup_vectors(spark, folder):
    """Every mixed vector, in millionths, with partner and weight, by draws that SQL repeats."""
    mixed = R.mixup_pairs(_vectors(spark, folder).filter("label = 1"), "embedding", "vec_id")
    return mixed.select("id", "draw", "partner", r6("weight").alias("weight"), _millionths("vec").alias("vec"))


@query("R8", "T-6", sql=f"""
WITH {CUSTOMER_STATIC}, tr AS (SELECT * FROM static WHERE outcome IN ('Cured', 'Died')),
m AS (SELECT (SELECT quantile_cont(balance, 0.5) FROM tr) AS mb, (SELECT quantile_cont(credit, 0.5) FROM tr) AS mc,
      (SELECT segment FROM tr WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS ms),
f AS (SELECT entity_id, coalesce(balance, mb) AS b, coalesce(credit, mc) AS c, coalesce(segment, ms) AS segment, outcome FROM static, m),
t AS (SELECT avg(b) AS ab, stddev_pop(b) AS sb, avg(c) AS ac, stddev_pop(c) AS sc FROM f WHERE outcome IN ('Cured', 'Died'))
SELECT entity_id, round((b - ab) / sb, 6) + 0.0::DOUBLE AS balance, round((c - ac) / sc, 6) + 0.0::DOUBLE AS credit, segment, outcome FROM f, t""")
def tabular_preprocess(spark, folder):
    static = customer_static(spark, folder).select("entity_id", "balance", "credit", "segment", "outcome")
    train = static.filter(F.col("outcome").isin("Cured", "Died"))
    filled = fill_central(static, ["balance", "credit", "segment"], fit_on=train)
    fit = scale_fit(filled.filter(F.col("outcome").isin("Cured", "Died")), ["balance", "credit"])
    scaled = standardize(filled, fit, ["balance", "credit"])
    return scaled.withColumns({"balance": r6("balance"), "credit": r6("credit")})


@query("R7", sql=f"""
WITH {EVENT_PANEL}, m AS (SELECT round(avg(missed), 6) AS missed FROM panel),
t AS (SELECT 'low' AS template, 10.0::DOUBLE AS doses, 0.0::DOUBLE AS missed UNION ALL SELECT 'base', (SELECT avg(doses) FROM panel), (SELECT avg(missed) FROM panel))
SELECT template, round(doses, 6) AS doses, round(missed, 6) AS missed, CAST(copy AS INTEGER) AS copy FROM t, (SELECT unnest(range(1, 129)) AS copy)""")
def template_rows(spark, folder):
    panel = event_panel(spark, folder).select("doses", "missed")
    rows = M.template_rows(panel, ["doses", "missed"], {"base": {}, "low": {"doses": 10, "missed": 0}}, copies=128)
    return rows.withColumns({"doses": r6("doses"), "missed": r6("missed")})


@query("R1", "X2", "R17")
def wide_panel_scores(spark, folder):
    """One wide row per entity scored by a plain logistic model on all step columns."""
    wide = panel_to_wide(event_panel(spark, folder), "entity_id", ["doses", "missed"]).fillna(0.0)
    names = [c for c in wide.columns if c != "entity_id"]
    total = sum((F.col(c) for c in names if c.endswith("_missed")), F.lit(0.0))
    rows = wide.withColumn("label", (total > 16).cast("int"))
    model = M.fit_classifier(rows, names, "label", "logistic")
    return M.score(model, rows).select("entity_id", "label", r6("probability").alias("probability"))


@query("R1", "R2", "M16", "T-6", "X3", "F5", "P29")
def model_inputs(spark, folder):
    """Customers with a recorded outcome and their order panel as one training table."""
    from panelwright.plans.model_inputs import prepare_model_inputs

    static = customer_static(spark, folder).select("entity_id", "balance", "segment", "outcome")
    made = prepare_model_inputs(static, order_panel(spark, folder), "entity_id", ["n_orders", "filled"])
    keep = ["mean_n_orders", "trend_filled", "balance", "segment_BUILDING", "n_orders__missing"]
    return made.table.select("entity_id", "step", "label", "split", *[c for c in keep if c in made.table.columns])
