"""Binary evaluation: confusion metrics, rank metrics, curves, thresholds, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.ordering import null_safe_join, prefix_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Closed forms of the confusion counts; 0 where a denominator is empty."""
    n = tp + fp + fn + tn
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    specificity, npv = _ratio(tn, tn + fp), _ratio(tn, tn + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_negative = _ratio(2 * tn, 2 * tn + fp + fn)
    spread = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = _ratio(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(spread))
    actual, predicted = _ratio(tp + fn, n), _ratio(tp + fp, n)
    return {
        "accuracy": _ratio(tp + tn, n),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "specificity": specificity,
        "negative_precision": npv,
        "negative_f1": f1_negative,
        "macro_f1": (f1 + f1_negative) / 2,
        "min_class_recall": F.least(recall, specificity),
        "mcc": mcc,
        "actual_rate": actual,
        "predicted_rate": predicted,
        "class_rate_gap": F.abs(predicted - actual),
    }


def binary_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: confusion counts, derived metrics and mean score by true class."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    counts = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count_if(y & hit).alias("tp"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(~y & ~hit).alias("tn"),
        F.avg(F.when(y, F.col(score))).alias("mean_score_positive"),
        F.avg(F.when(~y, F.col(score))).alias("mean_score_negative"),
    )
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        *[v.alias(k) for k, v in metric_columns(*cells).items()],
        "mean_score_positive", "mean_score_negative",
    )


def _by_score(
    df: DataFrame, label: str, score: str, by: Sequence[str], few_groups: bool = False
) -> DataFrame:
    """Distinct scores with positives and negatives, at and below each score."""
    counts = df.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return prefix_sums(counts, ["_score"], ["pos", "neg"], by, few_groups=few_groups and bool(by))


def rank_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    """Exact ROC-AUC and average precision per group; null where one class is absent.

    ``few_groups`` says that the groups are a short list, such as steps, folds or splits.
    """
    placed = _by_score(df, label, score, by, few_groups)
    concordant = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    sums = (placed.groupBy(*by) if by else placed.groupBy()).agg(
        F.sum(concordant).alias("_c"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("_ap"),
        F.max("total_pos").alias("_p"),
        F.max("total_neg").alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("_c") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def curve_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, one per distinct score used as threshold."""
    placed = _by_score(df, label, score, by)
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    return placed.select(
        *by,
        F.col("_score").alias("threshold"),
        _ratio(tp, F.col("total_pos")).alias("tpr"),
        _ratio(fp, F.col("total_neg")).alias("fpr"),
        _ratio(tp, tp + fp).alias("precision"),
    )


OBJECTIVES = {
    "balanced": lambda m: 0.40 * m["f1"] + 0.30 * m["recall"] + 0.30 * m["specificity"],
    "failure_recall": lambda m: 0.55 * m["specificity"]
    + 0.25 * m["balanced_accuracy"]
    + 0.20 * m["f1"],
    "specificity": lambda m: 0.50 * m["specificity"] + 0.30 * m["f1"] + 0.20 * m["recall"],
    "f1": lambda m: m["f1"],
    "accuracy": lambda m: m["accuracy"],
}


def grid(low: int = 10, high: int = 90) -> list[float]:
    """Thresholds in hundredths, both ends included."""
    return [i / 100 for i in range(low, high + 1)]


def _thresholds_passed(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the sorted thresholds the score reaches.

    On an even grid a division finds the place and its two neighbours settle rounding;
    any other list is searched by halving.
    """
    size = len(thresholds)
    bounds = F.array(*[F.lit(t) for t in thresholds])
    step = (thresholds[-1] - thresholds[0]) / (size - 1) if size > 1 else 1.0
    even = all(abs(t - thresholds[0] - i * step) < step / 4 for i, t in enumerate(thresholds))
    if not even:
        halvings = F.array(*[F.lit(1 << i) for i in range(size.bit_length() - 1, -1, -1)])
        return F.aggregate(
            halvings,
            F.lit(0),
            lambda at, jump: at
            + F.when(score >= F.get(bounds, at + jump - 1), jump).otherwise(0),
        )
    near = F.floor((score - thresholds[0]) / step).cast("int") + 1
    near = F.least(F.greatest(near, F.lit(0)), F.lit(size))
    up = F.coalesce(score >= F.get(bounds, near), F.lit(False)).cast("int")
    down = F.coalesce(score < F.get(bounds, near - 1), F.lit(False)).cast("int")
    return near + up - down


def threshold_table(
    df: DataFrame,
    label: str,
    score: str,
    thresholds: Sequence[float] | None = None,
    objective: str = "balanced",
    min_precision: float = 0.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every threshold with its metrics and objective score.

    Rows are counted once into the interval between two thresholds they fall in; the
    metrics of all thresholds follow from that short histogram. The objective ``auc_recall``
    (0.6 AUC + 0.4 recall) also needs the rank metrics.
    """
    thresholds = sorted(thresholds or grid())
    bounds = F.array(*[F.lit(t) for t in thresholds])
    size = len(thresholds)
    passed = _thresholds_passed(F.col(score), thresholds)
    bins = df.groupBy(*by, passed.alias("_i")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    entry = F.struct(F.col("_i"), F.struct("pos", "neg"))
    gathered = (bins.groupBy(*by) if by else bins.groupBy()).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_h"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    rows = gathered.select(
        *by, "_h", "_pos", "_neg", F.posexplode(bounds).alias("_at", "threshold")
    )
    above = F.sequence(F.col("_at") + 1, F.lit(size))

    def counted(side: str) -> Column:
        return F.aggregate(
            above,
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.coalesce(F.try_element_at("_h", i)[side], F.lit(0)),
        )

    rows = rows.select(*by, "threshold", "_pos", "_neg", counted("pos").alias("tp"), counted("neg").alias("fp"))
    rows = rows.withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_neg") - F.col("fp")})
    m = metric_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    names = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy")
    out = rows.select(*by, "threshold", "tp", "fp", "fn", "tn", *[m[k].alias(k) for k in names])
    if objective == "auc_recall":
        auc = rank_metrics(df, label, score, by).select(*by, "roc_auc")
        out = null_safe_join(out, auc, by) if by else out.withColumn("roc_auc", auc.select("roc_auc").scalar())
        value = 0.6 * F.coalesce("roc_auc", F.lit(0.0)) + 0.4 * F.col("recall")
        out = out.withColumn("score", value).drop("roc_auc")
    else:
        out = out.withColumn("score", OBJECTIVES[objective]({k: F.col(k) for k in names}))
    return out.withColumn("score", F.when(F.col("precision") >= min_precision, F.col("score")))


def best_threshold(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best row per group; the lowest threshold wins a tie. Without any admissible
    threshold, the best f1 / specificity / recall decides."""
    row = F.struct(*table.columns)
    order = F.struct(
        F.col("score").isNotNull().alias("ok"),
        F.coalesce("score", "f1").alias("a"),
        F.when(F.col("score").isNull(), F.col("specificity")).alias("b"),
        F.when(F.col("score").isNull(), F.col("recall")).alias("c"),
        (-F.col("threshold")).alias("d"),
    )
    grouped = table.groupBy(*by) if by else table.groupBy()
    return grouped.agg(F.max_by(row, order).alias("_best")).select("_best.*")


def per_step_evaluation(
    df: DataFrame, label: str, score: str, threshold: float, step: str = "step"
) -> DataFrame:
    """All metrics per step from one scored long table."""
    return binary_metrics(df, label, score, threshold, [step]).join(
        rank_metrics(df, label, score, [step]), step
    )


def selection_score(auc: Column, recall: Column) -> Column:
    return 0.6 * F.coalesce(auc, F.lit(0.0)) + 0.4 * recall


def candidate_score(metrics: DataFrame) -> DataFrame:
    """Adds ``candidate_score`` to rows with train / validation figures of a candidate.

    Columns: train_balanced, val_balanced, val_auc, val_recall, clinical_delta, high_risk_p.
    """
    gap = F.greatest(F.lit(0.0), F.col("train_balanced") - F.col("val_balanced"))
    bonus = F.when(
        F.col("clinical_delta") > 0, F.least(F.lit(0.20), F.col("clinical_delta")) * 2.0
    ).otherwise(0.0) + F.least(F.lit(0.30), F.col("high_risk_p")) * 0.5
    base = selection_score(F.col("val_auc"), F.col("val_recall"))
    return metrics.withColumn("candidate_score", base - 0.75 * gap + bonus)


def deployment_status(train_val_gap: Column, train_test_gap: Column) -> Column:
    return (
        F.when((train_val_gap <= 0.10) & (train_test_gap <= 0.12), "ACCEPTABLE")
        .when((train_val_gap <= 0.15) & (train_test_gap <= 0.15), "REVIEW")
        .otherwise("REJECT_STRONG_OVERFIT")
    )


def overfit_warnings(metrics: DataFrame) -> DataFrame:
    """Adds status and the list of warnings to rows of train / validation / test figures."""
    tv = F.col("train_balanced") - F.col("val_balanced")
    tt = F.col("train_balanced") - F.col("test_balanced")
    rules = [
        (tv > 0.10, "train_validation_gap"),
        (tt > 0.12, "train_test_gap"),
        (F.col("test_min_recall") < 0.50, "weak_class_recall"),
        (F.abs(F.col("test_predicted_rate") - F.col("test_actual_rate")) > 0.10, "class_rate_gap"),
        (F.col("test_predicted_rate") > F.col("test_actual_rate") + 0.10, "positive_bias"),
        (
            F.col("test_predicted_rate") < F.greatest(F.lit(0.0), F.col("test_actual_rate") - 0.10),
            "negative_bias",
        ),
        (F.col("test_mean_positive") <= F.col("test_mean_negative"), "no_separation"),
    ]
    warnings = F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))
    return metrics.withColumns({"status": deployment_status(tv, tt), "warnings": warnings})


def auc_over_folds(df: DataFrame, label: str, score: str, fold: str = "fold") -> DataFrame:
    """Mean and population sd of the per-fold AUC."""
    return rank_metrics(df, label, score, [fold]).agg(
        F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_sd"),
        F.count("roc_auc").alias("folds"),
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
