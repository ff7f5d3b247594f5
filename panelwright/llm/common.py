"""Helpers that several operators share: landing, distributed components, words, hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import ensure_checkpoint_dir

#: Characters that end a word where a contract splits on white space.
BLANK = "\\x20\\x09-\\x0D"
#: Words between blanks, as a Java and a Python pattern alike.
BLANK_WORD = f"[^{BLANK}]+"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back.

    It cuts the lineage: a lost executor costs a re-read, never the steps before it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python by at most ``rows`` at a time, so that workers stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def word_count(text: Column) -> Column:
    """Number of words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)).cast("long"), F.lit(0).cast("long"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` by alternating large and small stars.

    Returns ``node, component`` for each node that has an edge; the component is its smallest
    node. Every step joins edges to one minimum per node, so no neighbourhood is gathered and
    Spark can split the join of a node with very many edges.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def small_star(e: DataFrame) -> DataFrame:
        low = minima(e)
        return (
            e.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).withColumn("m", F.least("u", "m"))
        return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = landed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges"
    )
    before = None
    while (now := mark(state)) != before:
        before = now
        state = landed(small_star(large_star(state)), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def pieces(text: str, separator: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end at a separator, so no word is cut."""
    start = 0
    while len(text) - start > size:
        found = separator.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
