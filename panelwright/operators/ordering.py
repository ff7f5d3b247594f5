"""Distributed order statistics: running sums, ranks and exact quantiles.

A window without a selective partition key would pull a whole table into one task. Here
the order axis is cut into buckets first: bucket totals give each bucket its carry-in and
only rows of one bucket meet in a task. Tied values are counted before anything is
ordered, so a value that holds a third of the table is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of an order axis: their totals meet in one task per group, their rows one bucket at a time.
FEWEST_BUCKETS, MOST_BUCKETS = 256, 1 << 16
HASH_BITS = 16
_BUCKET = "_bucket"


def bucket_count(df: DataFrame) -> int:
    """Buckets for the order axis: about one per shuffle partition, as a power of two."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = FEWEST_BUCKETS
    while size < min(wanted, MOST_BUCKETS):
        size *= 2
    return size


def _locate(value: Column, bounds: Column, buckets: int) -> Column:
    """Number of bounds below ``value``: a binary search over a sorted array column."""
    halvings = F.array(*[F.lit(1 << i) for i in range((buckets - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(
        halvings,
        F.lit(0),
        lambda at, step: at + F.when(value > F.get(bounds, at + step - 1), step).otherwise(0),
    )


def with_quantile_bucket(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    buckets: int | None = None,
    few_groups: bool = False,
    counts: Sequence[str] = (),
) -> DataFrame:
    """Adds a bucket number that grows with ``order`` and splits each group evenly.

    With ``few_groups`` (the caller knows the groups, such as a list of columns) the bounds
    of all groups travel as one map and the rows stay where they are; otherwise they are
    joined on. ``counts`` names non-negative columns the caller reads as well: mentioning
    them here makes the bounds come from the very exchange the rows come from, so Spark
    reuses it instead of aggregating the table a second time.
    """
    buckets = buckets or bucket_count(df)
    source = df.filter(sum((F.col(c) for c in counts), F.lit(0)) >= 0) if counts else df
    probs = F.lit(np.arange(1, buckets) / buckets)
    bounds = F.percentile_approx(order, probs, buckets * 10).alias("_bounds")
    if by and few_groups:
        keyed = source.groupBy(*by).agg(bounds)
        table = keyed.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*by), "_bounds"))))
        df = df.withColumn("_all", table.scalar()).withColumn(
            "_bounds", F.try_element_at(F.col("_all"), F.struct(*by))
        ).drop("_all")
    elif by:
        df = null_safe_join(df, source.groupBy(*by).agg(bounds), by)
    else:
        df = df.withColumn("_bounds", source.agg(bounds).scalar())
    return df.withColumn(
        _BUCKET, F.coalesce(_locate(F.col(order), F.col("_bounds"), buckets), F.lit(0))
    ).drop("_bounds")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null meets null; right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    bucket: Column | None = None,
    buckets: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Adds ``before_x`` (sum of x over earlier rows) and ``total_x`` for each x in ``sums``,
    which are counts.

    ``order`` must be unique inside a group, so aggregate ties first. ``bucket`` may give a
    bucket number that never decreases along ``order``; otherwise quantiles of the first
    order column decide.
    """
    by = list(by)
    narrow = set(df.columns) <= {*by, *order, *sums}
    if bucket is None:
        cut = with_quantile_bucket(df, order[0], by, buckets, few_groups, sums)
    else:
        cut = df.withColumn(_BUCKET, bucket)
    if narrow:
        # Totals and rows both start from this exchange; counting the order columns keeps
        # its columns the same for both, so that Spark runs it once.
        cut = cut.repartition(*by, _BUCKET)
        same = [F.count(c).alias(f"_same_{c}") for c in order]
        totals = cut.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(s) for s in sums], *same)
        totals = totals.filter(sum((F.col(f"_same_{c}") for c in order), F.lit(0)) >= 0)
    else:
        # Wide rows: their totals combine on the map side and shuffle a few rows only.
        totals = cut.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(s) for s in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by,
        _BUCKET,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_carry_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"total_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_local_{s}") for s in sums]
    )
    joined = null_safe_join(local, carry, [*by, _BUCKET])
    return joined.select(
        *df.columns,
        *[(F.col(f"_carry_{s}") + F.col(f"_local_{s}")).alias(f"before_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def row_numbers(
    df: DataFrame,
    order: Sequence[str],
    name: str = "row_number",
    by: Sequence[str] = (),
    bucket: Column | None = None,
    size: str | None = None,
) -> DataFrame:
    """Dense 1-based position inside the group along a unique order, and the group's size."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(one, order, ["_one"], by, bucket)
    extra = [F.col("total__one").alias(size)] if size else []
    return out.select(*df.columns, (F.col("before__one") + 1).alias(name), *extra)


def digest_place(*key: Column, seed: int = 0, digits: int = 15) -> Column:
    """The first hex digits of the MD5 of the key's text and the seed, as a number."""
    text = F.concat_ws(":", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def digest_order(*key: str, seed: int = 0) -> tuple[Column, Column]:
    """A reproducible random order over ``key``, with the bucket number it implies: the digest's
    leading bits, so buckets follow the order."""
    place = digest_place(*[F.col(k) for k in key], seed=seed)
    return place, F.shiftright(place, 60 - HASH_BITS).cast("int")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its count ``n`` and tie-averaged rank ``avg_rank``."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = prefix_sums(counts, [value], ["n"], by)
    return placed.select(
        *by, value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value) rows of the non-null numeric cells."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    return (
        df.select(*by, F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    buckets: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (by..., column).

    The built-in exact ``percentile`` keeps every distinct value of a group in one task;
    this version never does. ``few_groups`` says that ``by`` has a short list of values.
    """
    keys = [*by, "column"]
    counts = (
        long_values(df, columns, by)
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = prefix_sums(counts, ["value"], ["n"], keys, buckets=buckets, few_groups=few_groups or not by)
    last = F.col("total_n") - 1
    picks = []
    for name, p in probs.items():
        for side, at in (("lo", F.floor(last * p)), ("hi", F.ceil(last * p))):
            here = (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(*keys).agg(F.max("total_n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        position = (F.col("n") - 1) * p
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*keys, "n", *out)


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10000,
) -> DataFrame:
    """The same table from one pass of mergeable sketches: rank error within 1 / accuracy."""
    wanted = F.array(*[F.lit(p) for p in probs.values()])
    sketched = long_values(df, columns, by).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", wanted, accuracy).alias("_q")
    )
    return sketched.select(
        *by, "column", "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
    )


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """One row holding the median of each column under its own name."""
    table = (exact_quantiles if exact else approx_quantiles)(df, columns, {"median": 0.5})
    return table.agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row holding each column's most frequent text; ties go to the smallest."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = [
        F.min(
            F.when(F.col("column") == c, F.struct((-F.col("n")).alias("k"), F.col("value")))
        )["value"].alias(c)
        for c in columns
    ]
    return counts.agg(*best)


def keyed_values(table: DataFrame, key: str, value: str) -> Column:
    """A table of few keys as a map column (scalar subquery): a lookup without a join.

    For keys known to be few, such as classes or column names. A join on them would gather
    a large table in as many tasks as there are keys.
    """
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


#: Rows of a lookup table that every task may hold as a map, and copies of a longer one's rows.
LOOKUP_ROWS, LOOKUP_SALTS = 10_000, 16


def looked_up(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the ``value`` that ``table``, unique by ``table_key``, holds for ``key``; else null.

    The table is counted first. A short one becomes a map in every task, so a key that a third
    of the rows share moves nothing. A longer one is joined with its rows copied to salts, over
    which a key's rows are spread by a hash of the whole row.
    """
    found = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v")).filter("_k is not null")
    if found.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return df.withColumn(name, F.try_element_at(keyed_values(found, "_k", "_v"), F.col(key).cast(found.schema["_k"].dataType)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(LOOKUP_SALTS)))
    copies = found.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_SALTS - 1).cast("long"))))
    joined = salted.join(copies, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_at")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("_v").alias(name))


def attach(df: DataFrame, fit: DataFrame, name: str) -> DataFrame:
    """Adds a one-row fit table to every row as a struct column, as a scalar subquery."""
    return df.withColumn(name, fit.select(F.struct(*fit.columns)).scalar())
