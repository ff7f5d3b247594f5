"""Exact range join of embeddings inside a label, over cells around pivots.

Vectors are scaled to length one, where a cosine bound is a distance bound r. A vector's home
is the cell of its nearest pivot. By the triangle inequality a cell can hold a partner of y only
if y is within r of the ball around its pivot and, since home means nearest, within r of the
plane half-way between the two pivots; y visits those cells too. Each cell then compares its
home vectors with all that it holds, on its own, and misses no pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import components, landed

#: Vectors that a cell should hold, and pivots in all (which bounds what is broadcast).
CELL, MOST_PIVOTS = 1024, 32_768
#: Rows of a cell that one task compares with as many others, and rows measured against all pivots at once.
BLOCK, STEP = 2048, 256
SLACK = 1e-9


def unit(vectors: Iterable) -> np.ndarray:
    """Rows scaled to length one in double precision; large and tiny values don't overflow."""
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _local_labels(linked: np.ndarray, home: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each home and each other vector reaches inside one block."""
    far = np.iinfo(np.int64).max
    while True:
        best = np.minimum(home, np.where(linked, other[None, :], far).min(axis=1, initial=far))
        back = np.minimum(other, np.where(linked, best[:, None], far).min(axis=0, initial=far))
        if (best == home).all() and (back == other).all():
            return best, back
        home, other = best, back


def range_join(rows: DataFrame, id_: str, vector: str, label: str, cosine: float = 0.98) -> DataFrame:
    """Links and components of vectors with equal labels and a cosine of at least ``cosine``.

    Returns ``rows``' columns with ``n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable, its own included) and ``kept`` (it is that one). Rows with a null
    label, or a vector that is null, empty, zero or holds null or non-finite components, link
    with nothing; vectors of different lengths never link. Equal vectors of a label are one
    class, compared once and counted as often as they occur, so copies are not expanded. Null
    ids never become a component's name unless it has no other. An empty table stays empty;
    columns named as the three results are replaced.

    A cell's rows are compared in blocks of 2,048 by 2,048, so no task takes a whole cell; the
    output of a block is one count and one label per vector, never its pairs.
    """
    spark = rows.sparkSession
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("n_links", "component_id", "kept")]
    ok = F.col(label).isNotNull() & usable(F.col(vector))
    keyed = rows.select(F.struct(*kept).alias("row"), F.col(id_).alias("id"),
                        F.when(ok, F.col(label)).alias("g"), F.when(ok, F.col(vector)).alias("v"))
    classes = keyed.filter("g is not null").groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = landed(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    classes = classes.withColumn("len", F.size("v"))
    sizes = classes.groupBy("g", "len").agg(F.count("*").alias("m")).filter(F.col("m") > CELL)
    total = sizes.agg(F.sum("m")).first()[0] or 0
    cell = max(CELL, -(-total // MOST_PIVOTS))
    sizes = sizes.filter(F.col("m") > cell)  # so that there are no more than twice MOST_PIVOTS in all
    order = W.partitionBy("g", "len").orderBy("h")
    # Candidates by hash, about four times as many as needed, so that only they are ranked.
    drawn = (
        classes.join(sizes, ["g", "len"]).withColumn("h", F.xxhash64("c"))
        .filter(F.pmod("h", F.lit(1 << 20)) * cell < (4 << 20))
        .withColumn("no", F.row_number().over(order)).filter(F.col("no") <= F.ceil(F.col("m") / cell))
        .select("g", "len", "v").collect()
    )
    pivots: dict[tuple, list] = {}
    for r in drawn:
        pivots.setdefault((r.g, r.len), []).append(r.v)
    table = spark.sparkContext.broadcast({k: unit(v) for k, v in pivots.items()})
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def distances(group: tuple, vectors: list) -> np.ndarray:
        p = table.value[group]
        return np.sqrt(np.maximum(0, 2 - 2 * (unit(vectors) @ p.T)))

    def steps(parts: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        for part in parts:
            for group, own in part.groupby(["g", "len"], sort=False):
                for at in range(0, len(own), STEP):
                    yield group, own.iloc[at:at + STEP].reset_index(drop=True)

    def homes(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, own in steps(parts):
            home, ball = np.zeros(len(own), np.int64), np.zeros(len(own))
            if group in table.value:
                d = distances(group, list(own["v"]))
                home, ball = d.argmin(axis=1), d.min(axis=1)
            yield pd.DataFrame({"g": own["g"], "len": own["len"], "home": home, "ball": ball, "m": 1})

    kind = classes.schema["g"].dataType.simpleString()
    element = classes.schema["v"].dataType.simpleString()
    shape = (
        classes.select("g", "len", "v").mapInPandas(homes, f"g {kind}, len int, home int, ball double, m long")
        .groupBy("g", "len", "home").agg(F.max("ball").alias("ball"), F.sum("m").alias("m"))
    )
    # One line per pivot; labels without pivots have one cell and need no line.
    known = {}
    for r in shape.join(sizes.select("g", "len"), ["g", "len"], "left_semi").collect():
        known[(r.g, r.len, r.home)] = (r.ball, r.m)
    known = spark.sparkContext.broadcast(known)

    def place(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, own in steps(parts):
            if group not in table.value:
                yield own.assign(cell=0, home=True)[["g", "len", "v", "c", "n", "cell", "home"]]
                continue
            p, d = table.value[group], distances(group, list(own["v"]))
            home = d.argmin(axis=1)
            ball = np.array([known.value.get((*group, i), (-1.0, 0))[0] for i in range(len(p))])
            used, at = np.unique(home, return_inverse=True)
            between = np.sqrt(np.maximum(0, 2 - 2 * (p[used] @ p.T)))[at]
            plane = (d * d - d[np.arange(len(d)), home][:, None] ** 2) <= 2 * radius * between + SLACK
            visit = (ball >= 0)[None, :] & (d <= ball[None, :] + radius) & plane
            visit[np.arange(len(d)), home] = True
            at, to = np.nonzero(visit)
            yield own.iloc[at].assign(cell=to, home=to == home[at])[["g", "len", "v", "c", "n", "cell", "home"]]

    members = classes.select("g", "len", "v", "c", "n").mapInPandas(
        place, f"g {kind}, len int, v {element}, c long, n long, cell int, home boolean")
    members = landed(members, "members")
    held = members.groupBy("g", "len", "cell").agg(
        F.count("*").alias("all"), F.count(F.when(F.col("home"), 1)).alias("own"))
    held = held.select("g", "len", "cell", F.ceil(F.col("own") / BLOCK).cast("int").alias("rows"),
                       F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    members = members.join(held, ["g", "len", "cell"])
    spread = lambda n, salt: F.pmod(F.xxhash64(F.col("c"), F.lit(salt)), n).cast("int")
    # As a home row it meets every column block, as a column every row block.
    as_row = members.filter("home").select(
        "*", spread(F.col("rows"), 1).alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("row"))
    as_column = members.filter("rows > 0").select(
        "*", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), spread(F.col("columns"), 2).alias("j"), F.lit(False).alias("row"))
    dealt = as_row.unionByName(as_column).select("g", "len", "cell", "i", "j", "row", "c", "n", "v")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        rows_, cols = part[part["row"]], part[~part["row"]]
        if not len(rows_) or not len(cols):
            return pd.DataFrame({"c": [], "links": [], "to": []}).astype("int64")
        a, b = rows_["c"].to_numpy(), cols["c"].to_numpy()
        linked = (unit(rows_["v"]) @ unit(cols["v"]).T >= cosine) & (a[:, None] != b[None, :])
        links = linked @ cols["n"].to_numpy()
        best, back = _local_labels(linked, a, b)
        moved = back < b
        return pd.DataFrame({
            "c": np.concatenate([a, b[moved]]), "links": np.concatenate([links, np.zeros(moved.sum(), np.int64)]),
            "to": np.concatenate([best, back[moved]]),
        })

    found = landed(dealt.groupBy("g", "len", "cell", "i", "j").applyInPandas(compare, "c long, links long, to long"), "links")
    names = components(found.filter("c != to").select(F.col("c").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    classes = classes.join(names.withColumnRenamed("node", "c"), "c", "left").join(counts, "c", "left")
    classes = classes.withColumn("component", F.coalesce("component", "c"))
    lowest = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = classes.join(lowest, "component").select(
        "g", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = keyed.join(classes, ["g", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("row.*", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
