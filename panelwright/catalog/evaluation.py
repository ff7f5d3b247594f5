"""Evaluation queries on a scored table of lineitem size."""

from pyspark.sql import functions as F

from panelwright.catalog.inputs import SCORED_LINES, r6, scored_lines
from panelwright.catalog.registry import query
from panelwright.operators import evaluate as E
from panelwright.operators.features import stratified_folds as folds, stratified_split as split
from panelwright.operators.models import prediction_table as predictions
from panelwright.sources.tables import read_table

_T = 0.5


def _counts(by=""):
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
k AS (SELECT {keys} (count(*) FILTER (WHERE label = 1 AND score >= {_T}))::DOUBLE AS tp,
             (count(*) FILTER (WHERE label = 0 AND score >= {_T}))::DOUBLE AS fp,
             (count(*) FILTER (WHERE label = 1 AND score < {_T}))::DOUBLE AS fn,
             (count(*) FILTER (WHERE label = 0 AND score < {_T}))::DOUBLE AS tn,
             avg(score) FILTER (WHERE label = 1) AS mp, avg(score) FILTER (WHERE label = 0) AS mn
      FROM scored {group})"""


_METRICS = """
CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity,
round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS negative_precision, round(2 * tn / (2 * tn + fp + fn), 6) AS negative_f1,
round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
round(LEAST(tp / (tp + fn), tn / (tn + fp)), 6) AS min_class_recall,
round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
round((tp + fn) / (tp + fp + fn + tn), 6) AS actual_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_rate,
round(abs((tp + fp) - (tp + fn)) / (tp + fp + fn + tn), 6) AS class_rate_gap,
round(mp, 6) AS mean_score_positive, round(mn, 6) AS mean_score_negative"""


def _rounded(df, skip=("tp", "fp", "fn", "tn", "step", "threshold")):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({c: r6(c) for c in doubles})


@query("R10", "A22", sql=f"WITH {SCORED_LINES}, {_counts()} SELECT {_METRICS} FROM k")
def binary_metrics(spark, folder):
    return _rounded(E.binary_metrics(scored_lines(spark, folder), "label", "score", _T))


_RANKS = """
r AS (SELECT {k} label, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {k} score) - 1) / 2.0::DOUBLE AS rk FROM scored),
auc AS (SELECT {k} (sum(rk) FILTER (WHERE label = 1) - (count(*) FILTER (WHERE label = 1)) * ((count(*) FILTER (WHERE label = 1)) + 1) / 2.0::DOUBLE)
        / ((count(*) FILTER (WHERE label = 1))::DOUBLE * (count(*) FILTER (WHERE label = 0))) AS roc_auc FROM r {g}),
c AS (SELECT {k} score, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM scored GROUP BY {k} score),
ap AS (SELECT {k} pos, sum(pos) OVER ({p} ORDER BY score DESC) / sum(n) OVER ({p} ORDER BY score DESC)::DOUBLE AS prec FROM c),
pr AS (SELECT {k} sum(pos * prec) / sum(pos) AS pr_auc FROM ap {g})"""


@query("R11", sql=f"""
WITH {SCORED_LINES}, {_RANKS.format(k="", p="", g="")}
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM auc, pr""")
def auc_rank(spark, folder):
    return _rounded(E.rank_metrics(scored_lines(spark, folder), "label", "score"))


@query("R11", sql=f"""
WITH {SCORED_LINES}, c AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
w AS (SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp,
      sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n FROM c)
SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM w""")
def pr_curve(spark, folder):
    return _rounded(E.curve_points(scored_lines(spark, folder), "label", "score"))


_GRID = f"""
grid AS (SELECT unnest(range(10, 91)) / 100.0::DOUBLE AS threshold),
k AS (SELECT threshold, (count(*) FILTER (WHERE label = 1 AND score >= threshold))::DOUBLE AS tp,
             (count(*) FILTER (WHERE label = 0 AND score >= threshold))::DOUBLE AS fp,
             (count(*) FILTER (WHERE label = 1 AND score < threshold))::DOUBLE AS fn,
             (count(*) FILTER (WHERE label = 0 AND score < threshold))::DOUBLE AS tn
      FROM scored CROSS JOIN grid GROUP BY 1),
m AS (SELECT threshold, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
             coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / (tp + fn) AS recall,
             2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS specificity,
             (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM k)"""
_GRID_OUT = """
threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
round(specificity, 6) AS specificity, round(balanced_accuracy, 6) AS balanced_accuracy"""


@query("R12", sql=f"""
WITH {SCORED_LINES}, {_GRID}
SELECT {_GRID_OUT}, round(0.40 * f1 + 0.30 * recall + 0.30 * specificity, 6) AS score FROM m""")
def threshold_search(spark, folder):
    return _rounded(E.threshold_table(scored_lines(spark, folder), "label", "score"))


@query("R12", "A21", sql=f"""
WITH {SCORED_LINES}, {_GRID}
SELECT {_GRID_OUT}, round(0.55 * specificity + 0.25 * balanced_accuracy + 0.20 * f1, 6) AS score FROM m
WHERE precision >= 0.35 ORDER BY 0.55 * specificity + 0.25 * balanced_accuracy + 0.20 * f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, folder):
    table = E.threshold_table(
        scored_lines(spark, folder), "label", "score", objective="failure_recall", min_precision=0.35
    )
    return _rounded(E.best_threshold(table))


@query("R12", "R15", sql=f"""
WITH {SCORED_LINES}, {_RANKS.format(k="", p="", g="")}, {_GRID.replace("10, 91", "5, 96")}
SELECT {_GRID_OUT}, round(0.6 * roc_auc + 0.4 * recall, 6) AS score FROM m, auc""")
def threshold_auc_recall(spark, folder):
    return _rounded(E.threshold_table(
        scored_lines(spark, folder), "label", "score", E.grid(5, 95), objective="auc_recall"
    ))


@query("R13", "R10", "R11", sql=f"""
WITH {SCORED_LINES}, {_counts("step")}, {_RANKS.format(k="step,", p="PARTITION BY step", g="GROUP BY step")}
SELECT k.step, {_METRICS}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
FROM k JOIN auc ON auc.step = k.step JOIN pr ON pr.step = k.step""")
def per_step_eval(spark, folder):
    return _rounded(E.per_step_evaluation(scored_lines(spark, folder), "label", "score", _T))


@query("R14", "P32", sql=f"""
WITH {SCORED_LINES}
SELECT l_orderkey * 10 + l_linenumber AS row_key, round(LEAST(0.95::DOUBLE, GREATEST(0::DOUBLE, score)), 6) AS failure_probability,
       CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, round(GREATEST(score, 1 - score) * 100, 2) AS confidence_pct,
       CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM scored""")
def prediction_table(spark, folder):
    rows = scored_lines(spark, folder).withColumn("row_key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return predictions(rows, "row_key", "score")


@query("R2", sql="""
WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1),
e AS (SELECT segment, n, round(n * 0.7::DOUBLE) AS a, round(n * (0.7::DOUBLE + 0.2::DOUBLE)) AS b FROM c)
SELECT segment, unnest(['train', 'validation', 'test']) AS split,
       unnest([CAST(a AS BIGINT), CAST(b - a AS BIGINT), CAST(n - b AS BIGINT)]) AS entities FROM e""")
def stratified_split(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return split(customers, "c_custkey", "segment").groupBy("segment", "split").agg(
        F.count(F.lit(1)).alias("entities")
    )


@query("R3", sql="""
WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1)
SELECT segment, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS entities FROM c, (SELECT unnest(range(5)) AS f)""")
def stratified_folds(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return folds(customers, "c_custkey", "segment").groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("entities"))


@query("R2", "R3", sql="""
WITH c AS (SELECT c_custkey, c_mktsegment AS segment, ('0x' || substr(md5(concat_ws(':', c_custkey, 42)), 1, 15))::BIGINT AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY h, c_custkey) AS r, count(*) OVER (PARTITION BY segment) AS n FROM c)
SELECT c_custkey, segment, CASE WHEN r <= round(n * 0.7::DOUBLE) THEN 'train' WHEN r <= round(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'validation'
       ELSE 'test' END AS split, CAST((r - 1) % 5 AS INTEGER) AS fold FROM r""")
def split_members(spark, folder):
    """Which split and which fold each entity falls into."""
    customers = read_table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    dealt = folds(customers, "c_custkey", "segment").select("c_custkey", "fold")
    return split(customers, "c_custkey", "segment").join(dealt, "c_custkey")


@query("R2", "J3", sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def split_membership(spark, folder):
    from panelwright.operators.features import split_panel

    split_of = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_mktsegment") == "BUILDING", "test").otherwise("train").alias("split"),
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return split_panel(orders, split_of, "o_custkey", "test").select("o_orderkey", "o_custkey")


@query("R15", sql=f"""
WITH {SCORED_LINES}, {_counts("step")}, b AS (SELECT step, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba,
  LEAST(tp / (tp + fn), tn / (tn + fp)) AS mr, (tp + fp) / (tp + fp + fn + tn) AS pr, (tp + fn) / (tp + fp + fn + tn) AS ar, mp, mn FROM k),
j AS (SELECT a.step, a.ba AS tr, b.ba AS va, c.* FROM b a JOIN b ON b.step = (a.step + 1) % 7 JOIN b c ON c.step = (a.step + 2) % 7)
SELECT step, CASE WHEN tr - va <= 0.10 AND tr - ba <= 0.12 THEN 'ACCEPTABLE' WHEN tr - va <= 0.15 AND tr - ba <= 0.15 THEN 'REVIEW'
       ELSE 'REJECT_STRONG_OVERFIT' END AS status,
       concat_ws(',', CASE WHEN tr - va > 0.10 THEN 'train_validation_gap' END, CASE WHEN tr - ba > 0.12 THEN 'train_test_gap' END,
         CASE WHEN mr < 0.5 THEN 'weak_class_recall' END, CASE WHEN abs(pr - ar) > 0.1 THEN 'class_rate_gap' END,
         CASE WHEN pr > ar + 0.1 THEN 'positive_bias' END, CASE WHEN pr < GREATEST(0, ar - 0.1) THEN 'negative_bias' END,
         CASE WHEN mp <= mn THEN 'no_separation' END) AS warnings FROM (SELECT j.step, tr, va, ba, mr, pr, ar, mp, mn FROM j)""")
def overfit_diagnostics(spark, folder):
    m = E.binary_metrics(scored_lines(spark, folder), "label", "score", _T, ["step"])

    def side(shift, **names):
        return m.select(F.pmod(F.col("step") - shift, F.lit(7)).alias("step"), *[F.col(v).alias(k) for k, v in names.items()])

    rows = (
        side(0, train_balanced="balanced_accuracy")
        .join(side(1, val_balanced="balanced_accuracy"), "step")
        .join(side(2, test_balanced="balanced_accuracy", test_min_recall="min_class_recall",
                   test_predicted_rate="predicted_rate", test_actual_rate="actual_rate",
                   test_mean_positive="mean_score_positive", test_mean_negative="mean_score_negative"), "step")
    )
    return E.overfit_warnings(rows).select("step", "status", F.array_join("warnings", ",").alias("warnings"))


@query("R3", "R11", sql=f"""
WITH {SCORED_LINES}, {_RANKS.format(k="step,", p="PARTITION BY step", g="GROUP BY step")}
SELECT round(avg(roc_auc), 6) AS auc_mean, round(stddev_pop(roc_auc), 6) AS auc_sd, count(*) AS folds FROM auc""")
def auc_over_folds(spark, folder):
    return _rounded(E.auc_over_folds(scored_lines(spark, folder), "label", "score", "step"))
