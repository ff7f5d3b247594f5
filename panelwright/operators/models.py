"""Fitting, scoring, calibration and the counterfactual gate, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.numeric import clamp_probability, confidence_pct, risk_band, sigmoid
from panelwright.operators.ordering import keyed_values
from panelwright.operators.profile import class_balance


def classifier(kind: str, label: str, weighted: bool = True, seed: int = 42, **options):
    """One of ``gbt``, ``forest``, ``logistic``, ``svm``, ``bayes`` over the ``_x`` vector."""
    base = {"featuresCol": "_x", "labelCol": label}
    if weighted:
        base["weightCol"] = "_weight"
    if kind == "gbt":
        return GBTClassifier(**{**base, "maxIter": 20, "maxDepth": 6, "stepSize": 0.1, "seed": seed, **options})
    if kind == "forest":
        return RandomForestClassifier(**{**base, "numTrees": 50, "maxDepth": 12, "seed": seed, **options})
    if kind == "logistic":
        return LogisticRegression(**{**base, "regParam": 0.01, "maxIter": 50, **options})
    if kind == "svm":
        return LinearSVC(**{**base, "regParam": 0.01, "maxIter": 30, **options})
    if kind == "bayes":
        return NaiveBayes(**{**base, "modelType": "gaussian", **options})
    raise ValueError(f"unknown classifier {kind!r}")


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``_weight`` = n / (classes * class size); unlabelled rows are left out."""
    weights = keyed_values(class_balance(df, label), label, "weight")
    return df.filter(F.col(label).isNotNull()).withColumn(
        "_weight", F.try_element_at(weights, F.col(label))
    )


def fit_classifier(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", weighted: bool = True,
    **options,
) -> PipelineModel:
    """Assembler and classifier as one reloadable pipeline; classes weighted by rarity."""
    ready = with_class_weights(train, label) if weighted else train
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    return Pipeline(stages=[assembler, classifier(kind, label, weighted, **options)]).fit(ready)


def score(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """Positive-class probability (margin through a sigmoid where the model has none)."""
    made = ("probability", "rawPrediction", "prediction")
    kept = [c for c in df.columns if c not in (*made, name)]
    out = model.transform(df.select(*kept))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = sigmoid(vector_to_array("rawPrediction")[1])
    return out.select(*kept, p.alias(name))


def score_foreign(
    df: DataFrame,
    load: Callable[[], Callable],
    features: Sequence[str],
    name: str = "probability",
) -> DataFrame:
    """Scores with any model outside Spark: loaded once per task, applied per Arrow batch."""
    columns = list(features)

    def run(batches: Iterator) -> Iterator:
        predict = load()
        for batch in batches:
            batch[name] = predict(batch[columns].to_numpy(dtype="float64"))
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, `{name}` double")


def prediction_table(
    scored: DataFrame, entity: str, probability: str, threshold: float = 0.5
) -> DataFrame:
    """Readable prediction per entity: clamped risk, confidence and band."""
    p = F.col(probability)
    return scored.select(
        entity,
        F.round(clamp_probability(p), 6).alias("failure_probability"),
        (p >= threshold).cast("int").alias("predicted"),
        F.round(confidence_pct(p), 2).alias("confidence_pct"),
        risk_band(p).alias("risk_level"),
    )


def fit_platt(df: DataFrame, logit: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through the validation logits."""
    pairs = df.select(logit, label)
    vectors = VectorAssembler(inputCols=[logit], outputCol="_x").transform(pairs)
    n = pairs.count()
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=1.0 / max(n, 1), standardization=False
    ).fit(vectors)
    return float(model.coefficients[0]), float(model.intercept)


def fit_temperature(
    df: DataFrame, logit: str, label: str, low: float = 1e-3, high: float = 100.0, rounds: int = 3
) -> float:
    """Temperature with the least log loss; each round reads the data once for 25 candidates."""
    import math

    best, lo, hi = 1.0, low, high
    for _ in range(rounds):
        points = [lo * (hi / lo) ** (i / 24) for i in range(25)]
        losses = df.agg(
            *[
                F.avg(
                    F.log1p(F.exp(-F.abs(F.col(logit) / t)))
                    + F.greatest(F.col(logit) / t, F.lit(0.0))
                    - F.col(label) * F.col(logit) / t
                ).alias(str(i))
                for i, t in enumerate(points)
            ]
        ).first()
        at = min(range(25), key=lambda i: losses[i] if losses[i] is not None else math.inf)
        best = points[at]
        lo, hi = points[max(0, at - 1)], points[min(24, at + 1)]
    return best


def template_rows(
    df: DataFrame,
    features: Sequence[str],
    templates: Mapping[str, Mapping[str, float]],
    fit: DataFrame | None = None,
    copies: int = 1,
) -> DataFrame:
    """Counterfactual feature rows per template name, ``copies`` of each.

    A feature not named by a template takes its mean in ``df``, which is zero after
    scaling. With ``fit`` (mean, sd structs) the rows are scaled like the model inputs.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in features])
    names = F.array(*[F.lit(n) for n in templates])
    rows = means.select("*", F.explode(names).alias("template"))
    for c in features:
        value = F.col(c)
        for name, fixed in templates.items():
            if c in fixed:
                value = F.when(F.col("template") == name, F.lit(float(fixed[c]))).otherwise(value)
        rows = rows.withColumn(c, value)
    if fit is not None:
        from panelwright.operators.stats import standardize

        rows = standardize(rows, fit, features)
    if copies > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return rows


def counterfactual_gate(
    scored: DataFrame, probability: str, min_high: float = 0.0, max_low: float = 1.0
) -> DataFrame:
    """One row: risk of the base / low / high templates and whether the model is acceptable.

    A model that does not raise the risk when adherence collapses is rejected.
    """
    pick = lambda name: F.max(F.when(F.col("template") == name, F.col(probability)))
    row = scored.agg(pick("base").alias("p_base"), pick("low").alias("p_low"), pick("high").alias("p_high"))
    rises = F.col("p_high") > F.col("p_low")
    bounded = (F.col("p_high") >= min_high) & (F.col("p_low") <= max_low)
    return row.select(
        "p_base", "p_low", "p_high",
        (F.col("p_high") - F.col("p_low")).alias("delta"),
        rises.alias("risk_rises"),
        bounded.alias("within_bounds"),
        (rises & bounded).alias("accepted"),
    )


def logit_of(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))
