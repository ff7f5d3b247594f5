"""Vectors scaled to integers, with exact products whatever their size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products of integers whose norms multiply to less are exact in double precision.
EXACT = 2.0**52
#: A component counts as no more than this, which only values beyond any long reach.
MOST = 2.0**62
LONG = (-(2**63), 2**63 - 1)


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component as a double, which holds it exactly."""
    def one(x: Column) -> Column:
        clipped = F.greatest(F.least(x.cast("double") * float(factor), F.lit(MOST)), F.lit(-MOST))
        return F.floor(clipped).cast("double")

    return F.transform(vector, one)


def finite(vector: Column) -> Column:
    """Not null, and no component null or non-finite; an empty vector is."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(vectors: Iterable) -> np.ndarray:
    rows = list(vectors)
    return np.array([np.asarray(v, np.float64) for v in rows]).reshape(len(rows), -1)


def whole(m: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)


def products(m: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact ``m @ v`` of integers; ``bound`` is at least the norms' product."""
    if bound < EXACT:
        return (m @ v).astype(np.int64)
    return whole(m) @ whole(v.reshape(1, -1))[0]


def as_long(x: int) -> int:
    """``x``, or the end of the range of a long that it lies beyond."""
    return min(max(int(x), LONG[0]), LONG[1])
