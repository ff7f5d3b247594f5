"""Moments of all pairs of columns, on pairwise complete rows, in one pass over the table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PARTS = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c")
#: First merges go in this many groups per column, so that no task takes the parts of all others.
SPREAD = 64
#: A spread below this share of the values' size is rounding: the column is constant.
ROUNDING = 1e-13


def _of_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Moments of every column of ``x`` with every column of ``y``; NaN marks a gap.

    Sums are taken of distances from the column's median, so that large values with a small
    spread lose no digits; a spread that is all rounding of these counts as none.
    """
    there, here = ~np.isnan(x), ~np.isnan(y)
    pivot_x, pivot_y = (np.array([np.median(col[m]) if m.any() else 0.0 for col, m in zip(v.T, k.T)]) for v, k in ((x, there), (y, here)))
    u, v = np.where(there, x - pivot_x, 0.0), np.where(here, y - pivot_y, 0.0)
    p, q = there.astype(float), here.astype(float)
    n = p.T @ q
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = np.where(n > 0, (u.T @ q) / n, 0.0), np.where(n > 0, (p.T @ v) / n, 0.0)
    square_a, square_b = (u * u).T @ q, p.T @ (v * v)
    m2a, m2b, c = square_a - n * a * a, square_b - n * b * b, u.T @ v - n * a * b
    m2a, m2b = np.where(m2a > ROUNDING * square_a, m2a, 0.0), np.where(m2b > ROUNDING * square_b, m2b, 0.0)
    return np.stack([n, a + pivot_x[:, None], b + pivot_y[None, :], m2a, m2b, c])


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = one[0] + two[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, two[0] / n, 0.0)
    da, db = two[1] - one[1], two[2] - one[2]
    both = one[0] * share
    # A side without rows has no mean of its own to differ by.
    da, db = np.where(both > 0, da, 0.0), np.where(both > 0, db, 0.0)
    empty = one[0] == 0
    return np.stack([
        n, np.where(empty, two[1], one[1] + da * share), np.where(empty, two[2], one[2] + db * share),
        one[3] + two[3] + da * da * both, one[4] + two[4] + db * db * both, one[5] + two[5] + da * db * both,
    ])


def _folder(width: int) -> Callable:
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                m = np.where(np.isfinite(m), m, np.nan)
                part = _of_rows(m[:, :width], m[:, width:])
                total = part if total is None else merged(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), *[pa.array(list(t)) for t in total]], names=["at", *PARTS])

    return fold


def _merge_lines(part: pd.DataFrame) -> pd.DataFrame:
    total = None
    for line in zip(*(part[k] for k in PARTS)):
        line = np.stack([np.asarray(v, float) for v in line])
        total = line if total is None else merged(total, line)
    return pd.DataFrame([{"at": part["at"].iat[0], **dict(zip(PARTS, total))}])


def pair_moments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """(a, b, n, mean_a, mean_b, m2_a, m2_b, c) for every column of ``left`` with every one of ``right``.

    The table is read once whatever the number of columns. A task folds its Arrow batches into
    one triangle of sums; these merge by column in two steps. Null and non-finite values are
    gaps. Without rows the result is empty.
    """
    left, right = list(left), list(right if right is not None else left)
    cells = [F.col(f"`{c}`").cast("double").alias(f"{side}{i}") for side, names in (("a", left), ("b", right)) for i, c in enumerate(names)]
    shape = "at int, " + ", ".join(f"{k} array<double>" for k in PARTS)
    lines = df.select(*cells).mapInArrow(_folder(len(left)), shape)
    lines = lines.groupBy("at", F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("group")).applyInPandas(_merge_lines, shape)
    lines = lines.groupBy("at").applyInPandas(_merge_lines, shape)
    of = lambda names, i: F.get(F.array(*[F.lit(c) for c in names]), i)
    flat = lines.select("at", F.posexplode(F.arrays_zip(*PARTS)).alias("to", "m"))
    return flat.select(of(left, F.col("at")).alias("a"), of(right, F.col("to")).alias("b"),
                       F.col("m.n").cast("long").alias("n"), *[F.col(f"m.{k}").alias(k) for k in PARTS[1:]])


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r, n): Pearson r on pairwise complete rows; null where a side is constant there."""
    table = pair_moments(df, left, right)
    flat = lambda s: F.col(f"m2_{s}") <= F.col("n") * F.pow(ROUNDING * F.abs(F.col(f"mean_{s}")), 2)
    r = F.least(F.greatest(F.try_divide("c", F.sqrt("m2_a") * F.sqrt("m2_b")), F.lit(-1.0)), F.lit(1.0))
    return table.select("a", "b", F.when(~flat("a") & ~flat("b"), r).alias("r"), "n")
