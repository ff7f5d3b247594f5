"""Centroid clustering in exact integers, with centroids filtered in rotated coordinates.

Vectors are turned so that the first coordinates hold most of the variance; of each, these
coordinates and the norm of the rest are stored. Distance of the first ones squared, plus the
difference of the two norms squared, is never over the squared distance itself, so it rules out
most centroids; the nearest of those left is found in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import landed
from panelwright.llm.integers import EXACT, as_long, finite, scaled, whole

#: Rotated coordinates that are kept.
LEAD = 16
#: What rounding may take from a bound, as a share of the squared norms.
SLACK = 1e-9
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rotation(count: int, total: np.ndarray, gram: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the ``lead`` orthonormal directions of most variance."""
    mean = total / max(1, count)
    spread = gram / max(1, count) - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return mean, np.eye(len(mean))[:, :lead]
    return mean, np.linalg.eigh(spread)[1][:, ::-1][:, :lead]


def turned(m: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the rest."""
    m = m - mean
    first = m @ axes
    rest = m - first @ axes.T
    return first, np.sqrt((rest * rest).sum(axis=1))


def exact_distances(m: np.ndarray, centre: list[int]) -> np.ndarray:
    """Squared distances of integer rows to an integer centre: exact, as int64 or Python integers."""
    if not len(m):
        return np.empty(0, np.int64)
    far = m - np.array(centre, np.float64)
    squares = (far * far).sum(axis=1)
    if squares.max() < EXACT and np.abs(m).max() < EXACT and max(map(abs, centre)) < EXACT:
        return squares.astype(np.int64)
    far = whole(m) - np.array(centre, dtype=object)
    return (far * far).sum(axis=1)


def assign(
    m: np.ndarray, first: np.ndarray, rest: np.ndarray, centres: list[list[int]], mean: np.ndarray, axes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, ties to the smaller number, and the exact squared distance."""
    rounded = np.array(centres, np.float64)
    near, norm = turned(rounded, mean, axes)
    low = (first * first).sum(axis=1)[:, None] + (near * near).sum(axis=1)[None, :] - 2 * (first @ near.T)
    low = np.maximum(0, low) + (rest[:, None] - norm[None, :]) ** 2
    size = ((m - mean) ** 2).sum(axis=1)[:, None] + ((rounded - mean) ** 2).sum(axis=1)[None, :]
    size += (np.abs(mean).max(initial=0.0)) ** 2
    low -= SLACK * size + 1e-6
    guess = low.argmin(axis=1)
    best, at = np.empty(len(m), object), guess.copy()
    for c in range(len(centres)):
        own = np.flatnonzero(guess == c)
        best[own] = exact_distances(m[own], centres[c])
    left = low <= best.astype(np.float64)[:, None]
    for c in range(len(centres)):
        own = np.flatnonzero(left[:, c] & (guess != c))
        d = exact_distances(m[own], centres[c])
        nearer = (d < best[own]) | ((d == best[own]) & (c < at[own]))
        own, d = own[nearer.astype(bool)], d[nearer.astype(bool)]
        best[own], at[own] = d, c
    return at, best


def _vectors(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return np.asarray(batch[name].flatten(), np.float64).reshape(batch.num_rows, size)


def _moments(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and products' sums, added up in the tasks and then by their place."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            m = _vectors(batch, "v", size)
            m = np.hstack([m, np.ones((len(m), 1))])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    added = vectors.select("v").mapInArrow(fold, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    total = np.zeros((size + 1) ** 2)
    for r in added.collect():  # (size + 1) squared numbers, whatever the table
        total[r.i] = r.x
    total = total.reshape(size + 1, size + 1)
    return int(total[-1, -1]), total[-1, :-1], total[:-1, :-1]


def _nearest(centres: list[list[int]], mean: np.ndarray, axes: np.ndarray, size: int) -> Callable:
    def one(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = _vectors(batch, "v", size)
        return m, *assign(m, _vectors(batch, "first", axes.shape[1]), np.asarray(batch["rest"]), centres, mean, axes)

    return one


def clusters(
    rows: DataFrame, vector: str, start: Column, size: int = 64, k: int = 16, rounds: int = 3, factor: int = 64,
    lead: int = LEAD,
) -> DataFrame:
    """``rows`` whose vector takes part, with ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.

    Vectors of exactly ``size`` components, none null or non-finite, take part; other rows are
    not returned. Components x count as ``floor(factor * x)``. The first ``k`` rows by ``start``
    (nulls last, equal ones by their vectors) are the first centroids; with fewer rows there are
    fewer. In each of ``rounds`` every vector goes to its nearest centroid, ties to the smaller
    number, and a centroid that has vectors becomes the floor of their mean per component; then
    vectors are assigned once more. All is exact in integers; a distance or a sum beyond a long
    is returned as the largest long. An empty table stays empty. Columns of ``rows`` named as
    results are replaced; all others pass through.

    A round reads the stored vectors once and adds up ``k`` sums in each task. Only centroids
    and sums, ``k`` rows each, reach the driver.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in RESULTS]
    v = F.col(f"`{vector}`")
    keyed = rows.filter((F.size(v) == size) & finite(v)).select(
        F.struct(*kept).alias("row"), scaled(v, factor).alias("v"), start.alias("start"))
    keyed = landed(keyed, "integers")
    lead = min(lead, size)
    first = keyed.orderBy(F.col("start").asc_nulls_last(), "v").limit(k).select("v").collect()
    centres = [[int(x) for x in r.v] for r in first]
    mean, axes = rotation(*_moments(keyed, size), lead)

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, rest = turned(_vectors(batch, "v", size), mean, axes)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, lead, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rest)], names=[*batch.schema.names, "first", "rest"])

    fields = keyed.drop("start").schema.fields
    stored = landed(keyed.drop("start").mapInArrow(turn, T.StructType([
        *fields, T.StructField("first", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])), "turned")

    for _ in range(rounds):
        nearest = _nearest(list(centres), mean, axes, size)

        def add(batches: Iterable[pa.RecordBatch], nearest=nearest) -> Iterator[pa.RecordBatch]:
            counts, sums = {}, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, at, _ = nearest(batch)
                small = np.abs(m).max(initial=0.0) * len(m) < EXACT
                for c in np.unique(at).tolist():
                    own = m[at == c]
                    part = own.sum(axis=0).astype(np.int64).astype(object) if small else whole(own).sum(axis=0)
                    counts[c] = counts.get(c, 0) + len(own)
                    sums[c] = sums[c] + part if c in sums else part
            order = sorted(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(order, pa.int32()), pa.array([counts[c] for c in order], pa.int64()),
                pa.array([[Decimal(int(x)) for x in sums[c]] for c in order], pa.list_(pa.decimal128(38, 0))),
            ], names=["cluster", "n", "sums"])

        parts = stored.select("v", "first", "rest").mapInArrow(add, "cluster int, n long, sums array<decimal(38,0)>")
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums"))
        for r in totals.collect():
            centres[r.cluster] = [int(x) // r.n for x in r.sums]

    nearest = _nearest(list(centres), mean, axes, size)

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, at, far = nearest(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], pa.array(at, pa.int32()), pa.array([as_long(x) for x in far], pa.int64())],
                    names=["row", "cluster", "distance"])

    done = landed(stored.mapInArrow(last, T.StructType([
        fields[0], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), "clusters")
    sums = {r.cluster: int(r.x) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    of = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), "cluster")
    return done.select(
        "row.*", "cluster", "distance", of([as_long(sums.get(c, 0)) for c in range(len(centres))], "bigint").alias("cluster_inertia"),
        F.lit(as_long(sum(sums.values()))).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"))
