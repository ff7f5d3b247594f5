"""Association tables and distribution repair."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwright.functions.numeric import clip
from panelwright.operators.ordering import (
    attach, average_ranks, exact_quantiles, keyed_values, looked_up, null_safe_join,
)
from panelwright.operators.moments import correlations
from panelwright.operators.windows import by_step


#: Pairs up to which one aggregation in the JVM is cheaper than batches in Python.
FEW_PAIRS = 120


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; null where a side is constant, which built-in corr
    answers with a division error in ANSI mode."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def pearson_pairs(
    df: DataFrame, columns: Sequence[str], min_obs: int = 10, pairs: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """(a, b, r, n) on pairwise complete rows; pairs below ``min_obs`` have a null r.

    All pairs come from one pass over the table: a few as one aggregation, many by
    :func:`correlations`. Non-finite values are gaps.
    """
    wanted = list(pairs) if pairs is not None else list(combinations(columns, 2))
    left, right = (list(dict.fromkeys(side)) for side in zip(*wanted)) if wanted else ([], [])
    if not wanted:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    if len(wanted) <= FEW_PAIRS:
        value = lambda c: F.col(c).cast("double")
        known = {c: F.when(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), value(c)) for c in (*left, *right)}
        cells = []
        for a, b in wanted:
            n = F.count_if(known[a].isNotNull() & known[b].isNotNull())
            r = F.when(n >= min_obs, safe_corr(known[a], known[b]))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), n.alias("n")))
        table = df.agg(F.count(F.lit(1)).alias("_all"), F.array(*cells).alias("_rows"))
        return table.filter("_all > 0").select(F.inline("_rows"))
    table = correlations(df, left, right)
    if len(wanted) < len(left) * len(right):
        keep = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted])
        table = table.filter(F.array_contains(keep, F.struct("a", "b")))
    return table.select("a", "b", F.when(F.col("n") >= min_obs, F.col("r")).alias("r"), "n")


def lag_correlation(
    panel: DataFrame, metric: str, entity: str, step: str = "step", min_pairs: int = 5
) -> DataFrame:
    """Pearson r between each step and the one before, over entities observed at both."""
    w = by_step(entity, step)
    pairs = panel.select(
        F.col(step),
        F.col(metric).alias("now"),
        F.when(F.lag(step).over(w) == F.col(step) - 1, F.lag(metric).over(w)).alias("before"),
    ).filter("now is not null and before is not null")
    table = pairs.groupBy(step).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("before"), F.col("now")).alias("r"))
    table = table.filter(F.col("n") >= min_pairs)
    p = correlation_p(F.col("r"), F.col("n"))
    return table.select(
        (F.col(step) - 1).alias("from_step"), F.col(step).alias("to_step"), "r", "n",
        p.alias("p_value"), (p < 0.05).alias("significant"),
    )


def step_correlation(
    panel: DataFrame, metric: str, entity: str, steps: Sequence[int], step: str = "step"
) -> DataFrame:
    """Pearson r of one metric between every pair of steps."""
    wide = panel.groupBy(entity).agg(
        *[F.max(F.when(F.col(step) == s, F.col(metric))).alias(f"s{s}") for s in steps]
    )
    table = pearson_pairs(wide, [f"s{s}" for s in steps], min_obs=2)
    number = [F.substring(c, 2, 9).cast("int").alias(f"step_{c}") for c in ("a", "b")]
    return table.select(*number, "r", "n")


@F.pandas_udf(T.DoubleType())
def _t_tail(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided t test of a correlation, for tables with one row per coefficient."""
    return pd.Series([_correlation_p(a, b) for a, b in zip(r, n)])


def correlation_p(r: Column, n: Column) -> Column:
    return _t_tail(r, n.cast("double"))


def _correlation_p(r: float, n: float) -> float | None:
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    t2 = r * r * dof / (1 - r * r)
    return beta_tail(dof / (dof + t2), dof / 2, 0.5)


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total / a


def chi2_tail(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q)."""
    if x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b = z + 1 - a
    c, d = 1e300, 1 / b
    total = d
    for i in range(1, 100000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, rho, n): Pearson r of tie-averaged ranks on complete rows.

    Rows are counted per distinct (a, b) value pair before ranks are joined on, so copies
    of one pair travel as one weighted row.
    """
    out = None
    for a, b in pairs:
        cells = (
            df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            .filter("x is not null and y is not null")
            .groupBy("x", "y")
            .agg(F.count(F.lit(1)).alias("w"))
        )
        ranked = cells
        for side in ("x", "y"):
            margin = cells.groupBy(side).agg(F.sum("w").alias("n"))
            ranked = looked_up(ranked, side, _weighted_ranks(margin, side), side, f"rank_{side}", f"rank_{side}")
        w, x, y = F.col("w"), F.col("rank_x"), F.col("rank_y")
        sums = ranked.agg(
            F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
            F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
            F.sum(w * x * y).alias("sxy"),
        )
        n = F.col("n")
        top = n * F.col("sxy") - F.col("sx") * F.col("sy")
        bottom = F.sqrt(
            (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
        )
        row = sums.select(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.when(bottom > 0, top / bottom).alias("rho"), n.alias("n"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _weighted_ranks(margin: DataFrame, side: str) -> DataFrame:
    from panelwright.operators.ordering import prefix_sums

    placed = prefix_sums(margin, [side], ["n"])
    return placed.select(side, (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"rank_{side}"))


def group_spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, rho, n) for small groups with unique x (for example one row per step)."""
    ry = average_ranks(df, y, [by]).select(by, F.col(y), F.col("avg_rank").alias("ry"))
    rx = average_ranks(df, x, [by]).select(by, F.col(x), F.col("avg_rank").alias("rx"))
    ranked = null_safe_join(null_safe_join(df.select(by, x, y), rx, [by, x]), ry, [by, y])
    return ranked.groupBy(by).agg(safe_corr(F.col("rx"), F.col("ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def cramers_v(
    df: DataFrame, columns: Sequence[str], yates: bool = True, min_obs: int = 10
) -> DataFrame:
    """(a, b, v, n) for every column pair with two or more levels on both sides.

    Every row is counted into one contingency cell per pair with map-side combining, and
    margins come from those cells, so the table is read once for all pairs. ``yates``
    applies the 2x2 continuity correction.
    """
    pair_cells = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb"),
        )
        for a, b in combinations(columns, 2)
    ]
    cells = (
        df.select(F.inline(F.array(*pair_cells)))
        .filter("va is not null and vb is not null")
        .groupBy("a", "b", "va", "vb")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    rows = cells.groupBy("a", "b", "va").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy("a", "b", "vb").agg(F.sum("o").alias("col_n"))
    size = cells.groupBy("a", "b").agg(
        F.sum("o").alias("n"),
        F.count_distinct("va").alias("levels_a"),
        F.count_distinct("vb").alias("levels_b"),
    )
    # One line per pair of columns: a map, since a join on so few keys would gather the cells.
    pair = F.struct("a", "b")
    facts = keyed_values(size.select(pair.alias("pair"), F.struct("n", "levels_a", "levels_b").alias("f")), "pair", "f")
    joined = cells.join(rows, ["a", "b", "va"]).join(cols, ["a", "b", "vb"]).withColumn("_f", F.try_element_at(facts, pair)).select(
        "*", "_f.*").drop("_f")
    n, r, c = F.col("n").cast("double"), F.col("row_n"), F.col("col_n")
    expected = r * c / n
    # Cells never observed still count: summing o^2/e over the seen cells and taking n off
    # includes them. In a 2x2 table |o - e| is one number, so any cell gives the statistic.
    gap = F.abs(F.col("o") - expected)
    step = gap - F.least(F.lit(0.5), gap)
    table = joined.groupBy("a", "b", "n", "levels_a", "levels_b").agg(
        F.sum(F.col("o") * F.col("o") / expected).alias("ratio"),
        F.max(F.try_divide(step * step * n * n * n, r * (n - r) * c * (n - c))).alias("corrected"),
    )
    two_by_two = (F.col("levels_a") == 2) & (F.col("levels_b") == 2)
    plain = F.col("ratio") - F.col("n")
    chi2 = F.when(two_by_two & F.lit(yates), F.col("corrected")).otherwise(plain)
    usable = (F.col("levels_a") >= 2) & (F.col("levels_b") >= 2) & (F.col("n") >= min_obs)
    v = F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * (F.least("levels_a", "levels_b") - 1)))
    return table.filter(usable).select("a", "b", v.alias("v"), "n")


def compare_association(before: DataFrame, after: DataFrame) -> DataFrame:
    """Association before and after a treatment of the data, on pairs present in both."""
    left = before.select("a", "b", F.col("v").alias("v_before"))
    right = after.select("a", "b", F.col("v").alias("v_after"))
    return left.join(right, ["a", "b"]).withColumn("change", F.col("v_after") - F.col("v_before"))


def outlier_limits(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """One row of struct columns: IQR fences, then sample-sd fences on the capped values."""
    q = exact_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    fences = [
        F.max(
            F.when(
                F.col("column") == c,
                F.struct(
                    (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
                    (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
                ),
            )
        ).alias(c)
        for c in columns
    ]
    iqr = attach(df.select(*columns), q.agg(*fences), "_iqr")
    aggs = []
    for c in columns:
        capped = _between(F.col(c), F.col(f"_iqr.{c}.low"), F.col(f"_iqr.{c}.high"))
        mean, sd = F.avg(capped), F.stddev_samp(capped)
        aggs.append(
            F.struct(
                F.max(f"_iqr.{c}.low").alias("low"), F.max(f"_iqr.{c}.high").alias("high"),
                (mean - z * sd).alias("z_low"), (mean + z * sd).alias("z_high"),
            ).alias(c)
        )
    return iqr.agg(*aggs)


def _between(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), low), high))


def cap_outliers(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    limits = outlier_limits(df, columns, z)
    wide = attach(df, limits, "_lim")
    for c in columns:
        capped = _between(F.col(c), F.col(f"_lim.{c}.low"), F.col(f"_lim.{c}.high"))
        wide = wide.withColumn(
            c, _between(capped, F.col(f"_lim.{c}.z_low"), F.col(f"_lim.{c}.z_high"))
        )
    return wide.drop("_lim")


def outlier_report(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """(column, iqr_outliers, z_outliers) as counted while capping."""
    wide = attach(df.select(*columns), outlier_limits(df, columns, z), "_lim")
    rows = []
    for c in columns:
        lim = F.col(f"_lim.{c}")
        capped = _between(F.col(c), lim["low"], lim["high"])
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if((F.col(c) < lim["low"]) | (F.col(c) > lim["high"])).alias("iqr_outliers"),
                F.count_if((capped < lim["z_low"]) | (capped > lim["z_high"])).alias("z_outliers"),
            )
        )
    return wide.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


#: Columns up to which their figures are one row of aggregates; of more, each value is a row.
WIDE_FIT = 32
_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double")


def scale_fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population sd per column from the rows given (the training rows).

    Hundreds of aggregates side by side are too long a method to be compiled, so of a wide table
    each task folds (column number, value) rows instead: same sums, in the same order.
    """
    kinds = dict(train.dtypes)
    if len(columns) <= WIDE_FIT or any(kinds.get(c) not in _PLAIN for c in columns):
        return train.agg(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c)
                for c in columns
            ]
        )
    values = F.array(*[F.col(c).cast("double") for c in columns])
    figures = train.select(F.posexplode(values).alias("_at", "_value")).groupBy("_at").agg(
        F.avg("_value").alias("mean"), F.stddev_pop("_value").alias("sd"))
    return figures.agg(
        *[
            F.struct(*[F.max(F.when(F.col("_at") == i, F.col(f))).alias(f) for f in ("mean", "sd")]).alias(c)
            for i, c in enumerate(columns)
        ]
    )


def is_binary_name(name: str, prefixes: Sequence[str] = ()) -> bool:
    """Feature names that stay 0/1 under selective scaling."""
    return (
        name.startswith(("is_missing_", *prefixes))
        or name.endswith("__missing")
        or name in ("xpert_mtb_rif", "smear_microscopy", "smear_tb_lamp")
    )


def standardize(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sd with training figures; a constant column is only centred."""
    wide = attach(df, fit, "_fit")
    for c in columns:
        sd = F.col(f"_fit.{c}.sd")
        wide = wide.withColumn(
            c, (F.col(c) - F.col(f"_fit.{c}.mean")) / F.when(sd > 0, sd).otherwise(1.0)
        )
    return wide.drop("_fit")


def density(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Gaussian kernel density at fixed points with Scott's bandwidth, as one aggregation.

    Each row adds its kernel to every evaluation point; partial sums combine map-side, so
    the cost is rows x points without any rows x points exchange.
    """
    value = F.col(column).cast("double")
    stats = df.agg(
        F.struct(
            F.count(value).alias("n"),
            (F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("h"),
        )
    ).scalar()
    rows = df.select(value.alias("v"), stats.alias("_s")).filter("v is not null")
    norm = math.sqrt(2 * math.pi)
    cells = []
    for p in points:
        z = (F.lit(float(p)) - F.col("v")) / F.col("_s.h")
        cells.append(
            F.struct(
                F.lit(float(p)).alias("point"),
                (F.sum(F.exp(-z * z / 2)) / (F.max("_s.n") * F.max("_s.h") * norm)).alias("density"),
            )
        )
    return rows.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))
