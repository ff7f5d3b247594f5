"""Cross-validation and the choice among candidate models."""

from pyspark.sql import functions as F

from panelwright.catalog.inputs import r6
from panelwright.catalog.modelling import _DOC, document_features
from panelwright.catalog.registry import query
from panelwright.operators.ordering import row_numbers
from panelwright.operators.validation import Recipe, cross_validate, fold_report
from panelwright.plans.experiment import FIGURES, choose_model
from panelwright.sources.tables import read_table

_FIGURES = ("roc_auc", "pr_auc", "auc_mean", "auc_sd")


def _report(spark, folder, recipe):
    scored = cross_validate(document_features(spark, folder), "doc_id", "label", _DOC, recipe)
    return fold_report(scored, "label").withColumns({c: r6(c) for c in _FIGURES})


@query("R3", "R9")
def cv_forest(spark, folder):
    """Five stratified folds: a forest per fold, its AUC, and the mean and deviation of all."""
    return _report(spark, folder, Recipe("forest", options={"numTrees": 200}))


@query("R3", "R4", "R5")
def cv_rebalanced(spark, folder):
    """The same with interpolated and edited rows inside each fold's training part."""
    return _report(spark, folder, Recipe("logistic", resample=True))


_CUTS = ("chars", "gaps", "breaks")


def _each(line, join=", "):
    return join.join(line.format(c=c) for c in _CUTS)


@query("R3", "R11", sql=f"""
WITH t AS (SELECT d.doc_id, l.quality AS label, coalesce(d.text, '') AS text FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT doc_id, label, length(text)::DOUBLE AS chars,
        CASE WHEN doc_id % 7 <> 0 THEN (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS gaps,
        (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS breaks,
        CAST((row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id) - 1) % 5 AS INTEGER) AS fold FROM t),
n AS (SELECT unnest(range(5))::INTEGER AS held),
m AS (SELECT held, {_each("quantile_cont({c}, 0.5) AS m_{c}")} FROM f JOIN n ON fold <> held GROUP BY 1),
g AS (SELECT held, doc_id, label, fold, {_each("coalesce({c}, m_{c}, 0) AS {c}")} FROM f, m),
s AS (SELECT held, {_each("avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}")} FROM g WHERE fold <> held GROUP BY 1),
z AS (SELECT held, doc_id, label, fold, {_each("({c} - a_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS {c}")} FROM g JOIN s USING (held)),
k AS (SELECT held, label AS y, ln(count(*) / sum(count(*)) OVER (PARTITION BY held)) AS p, {_each("avg({c}) AS u_{c}, var_pop({c}) + 1e-9 AS v_{c}")}
      FROM z WHERE fold <> held GROUP BY held, label),
b AS (SELECT z.held, doc_id, label, y, p - {_each("0.5 * (ln(2 * pi() * v_{c}) + pow({c} - u_{c}, 2) / v_{c})", " - ")} AS score
      FROM z JOIN k ON z.held = k.held WHERE fold = z.held),
o AS (SELECT held AS fold, doc_id, any_value(label) AS label,
        round(1 / (1 + exp(max(score) FILTER (WHERE y = 0) - max(score) FILTER (WHERE y = 1))), 6) AS probability FROM b GROUP BY 1, 2),
r AS (SELECT fold, label, (rank() OVER w + (count(*) OVER (PARTITION BY fold, probability) - 1) / 2.0) AS rank FROM o WINDOW w AS (PARTITION BY fold ORDER BY probability)),
u AS (SELECT fold, count(*) AS rows, (sum(rank) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc FROM r GROUP BY 1)
SELECT fold, rows, round(auc, 6) AS roc_auc, round(avg(auc) OVER (), 6) AS auc_mean, round(stddev_pop(auc) OVER (), 6) AS auc_sd FROM u""")
def cv_bayes(spark, folder):
    """Fill, scale and a Gaussian classifier inside every fold, on text counts with gaps."""
    text = F.coalesce("text", F.lit(""))
    less = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = read_table(spark, folder, "documents").select(
        "doc_id", F.length(text).cast("double").alias("chars"), F.when(F.col("doc_id") % 7 != 0, less(" ")).alias("gaps"),
        less("\n").alias("breaks"),
    ).join(labels, "doc_id")
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    placed = row_numbers(rows.withColumn("_h", place), ["_h", "doc_id"], "_r", ["label"])
    rows = placed.withColumn("part", ((F.col("_r") - 1) % 5).cast("int"))
    scored = cross_validate(rows, "doc_id", "label", _CUTS, Recipe("bayes", weighted=False), fold="part")
    report = fold_report(scored.withColumn("probability", r6("probability")), "label").drop("pr_auc")
    return report.withColumns({c: r6(c) for c in _FIGURES if c != "pr_auc"})


@query("R15", "R3", "R9", "R12", "R18")
def model_choice(spark, folder):
    """Three candidates with all their figures; the candidate score chooses one."""
    recipes = [Recipe("logistic"), Recipe("logistic", resample=True), Recipe("forest", options={"numTrees": 100})]
    templates = {"low": {"length": 4.0, "words": 10.0, "lines": 1.0}, "high": {"length": 8.0, "words": 500.0, "lines": 20.0}}
    made = choose_model(document_features(spark, folder), "doc_id", "label", _DOC, recipes, templates)
    return made.candidates.select(
        "candidate", *[r6(c).alias(c) for c in FIGURES], r6("candidate_score").alias("candidate_score"), "status", "chosen")
