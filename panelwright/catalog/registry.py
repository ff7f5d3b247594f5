"""Registry of the runnable queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None):
    """Registers a function under its own name, covering the listed inventory ids."""

    def wrap(fn: Runner) -> Runner:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return wrap
