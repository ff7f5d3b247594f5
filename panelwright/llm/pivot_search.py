"""Exact search for the largest inner products, by a table of distances to pivots.

Every vector's distances to some pivots (the origin is one) are computed once. By the triangle
inequality ``|d(q, p) - d(x, p)|`` is at most ``d(q, x)`` for each pivot p, and as
``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, the largest of these bounds limits the product from
above. Candidates are taken in the order of that limit until it falls below the k-th best exact
product found: no later one can be better. Blocks of candidates have the same limit by the range
of their distances, so a query visits only blocks that its k-th best, found in its own block
first, doesn't rule out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import landed
from panelwright.llm.integers import as_long, finite, matrix, products, scaled

#: Pivots of a vector length, and bytes of all of them (they are broadcast).
PIVOTS, PIVOT_BYTES = 32, 16 << 20
#: Vectors of a block, queries of a chunk, blocks of a chunk.
BLOCK, QUERIES, SUMMARIES = 2048, 1024, 1024
#: What rounding may add to a limit, as a share of the squared norms.
SLACK = 1e-9
#: Candidates evaluated at first; each further step takes twice as many.
STEP = 32


def limits(square: float, squares: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Most that the products with vectors at least ``apart`` away can be, rounding included."""
    both = square + squares
    return (both - apart * apart) / 2 + SLACK * both + 1e-6


def kth(scores: np.ndarray, copies: np.ndarray, k: int) -> float:
    """The k-th best score, ``copies`` counted; below every score if there are fewer."""
    order = np.argsort(-scores, kind="stable")
    enough = np.flatnonzero(np.cumsum(copies[order]) >= k)
    return float(scores[order[enough[0]]]) if len(enough) else -np.inf


def search(
    q: np.ndarray, square: float, away: np.ndarray, least: float, vectors: np.ndarray, squares: np.ndarray,
    table: np.ndarray, copies: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (by position) that are among the best ``k`` of the block and not below ``least``."""
    limit = limits(square, squares, np.abs(table - away).max(axis=1))
    order = np.flatnonzero(limit >= least)
    order = order[np.argsort(-limit[order], kind="stable")]
    bound = float(np.sqrt(square * squares.max(initial=0.0)))
    scores, at, step = np.empty(0, np.int64), 0, STEP
    while at < len(order) and limit[order[at]] >= least:
        found = products(vectors[order[at:at + step]], q, bound)
        if found.dtype == object:
            found = np.array([as_long(x) for x in found], np.int64)
        scores, at, step = np.concatenate([scores, found]), at + step, 2 * step
        least = max(least, kth(scores, copies[order[:len(scores)]], k))
    good = scores >= least
    return order[:len(scores)][good], scores[good]


def _best(rows: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` of (score, id, row): higher scores first, then smaller ids, null ids last."""
    return sorted(rows, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]


class _Block:
    """A block's vectors as arrays."""

    def __init__(self, part: pd.DataFrame):
        self.v, self.d = matrix(part["v"]), matrix(part["d"])
        self.squares = part["square"].to_numpy()
        self.rows = [[(r["id"], r["r"]) for r in rows] for rows in part["rows"]]
        self.copies = np.array([len(r) for r in self.rows], np.int64)

    def best(self, q: np.ndarray, square: float, away: np.ndarray, least: float, k: int) -> list[tuple]:
        found, scores = search(q, square, away, least, self.v, self.squares, self.d, self.copies, k)
        return _best([(int(s), *row) for x, s in zip(found, scores) for row in self.rows[x]], k)


def top_products(
    rows: DataFrame, id_: str, vector: str, query: Column, k: int = 5, factor: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest product with each query row.

    Components x count as the integer ``floor(factor * x)``. Rows for which ``query`` holds are
    queries; every other row with a vector of the same length is a candidate, another row with
    the same id or vector too. Equal scores go by the smaller id, null ids last; with fewer
    candidates a query has fewer rows, with none it has none. Vectors that are null or hold null
    or non-finite components take no part; an empty vector has product 0 with other empty ones.
    Products are exact; one beyond the range of a long counts as its end. An empty table gives
    an empty result, and other columns, however named, are not read.

    Equal vectors are one class that keeps its ``k + 1`` smallest ids, which suffice, so copies
    are compared once. Queries are dealt in chunks and classes in blocks; no task takes more.
    """
    keep = k + 1  # a query's own row is among the candidates until the end
    ok = finite(F.col(f"`{vector}`"))
    keyed = rows.filter(ok).select(
        F.col(f"`{id_}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), factor).alias("v"),
        F.coalesce(query, F.lit(False)).alias("query"))
    keyed = landed(keyed.withColumn("r", F.monotonically_increasing_id()), "vectors")
    first = W.partitionBy("v").orderBy(F.col("id").asc_nulls_last(), "r")
    members = keyed.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= keep)
    members = members.groupBy("v").agg(F.collect_list(F.struct("id", "r")).alias("rows"))
    asked = keyed.groupBy("v").agg(F.bool_or("query").alias("query"))
    classes = members.join(asked, "v").withColumn("len", F.size("v"))
    classes = landed(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    pivots = _pivots(classes)

    def measure(parts):
        for part in parts:
            for length, own in part.groupby("len", sort=False):
                m, p = matrix(own["v"]), pivots.get(length)
                squares = (m * m).sum(axis=1)
                d = np.sqrt(squares)[:, None]
                if p is not None:
                    # Rounding of the squared distance is relative to the squares, as SLACK is.
                    far = squares[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (m @ p.T)
                    d = np.hstack([d, np.sqrt(np.maximum(0, far))])
                home = d[:, 1:].argmin(axis=1) if d.shape[1] > 1 else np.zeros(len(own), np.int64)
                yield own.assign(square=squares, d=list(d), home=home)[
                    ["c", "len", "v", "rows", "query", "square", "d", "home"]]

    shape = "c long, len int, v array<double>, rows array<struct<id:bigint,r:bigint>>, query boolean, square double, d array<double>, home long"
    table = landed(classes.mapInPandas(measure, shape), "pivot-table")
    cells = table.groupBy("len", "home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    table = table.join(cells, ["len", "home"]).withColumn("part", F.pmod(F.xxhash64("c"), "parts")).drop("parts")
    spans = [F.array(*[f(F.get("d", F.lit(i))) for i in range(PIVOTS + 1)]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    blocks = table.groupBy("len", "home", "part").agg(
        *spans, F.max("square").alias("square"), F.bool_or("query").alias("query"))
    blocks = landed(blocks.withColumn("b", F.monotonically_increasing_id()), "blocks")
    table = landed(table.join(blocks.select("len", "home", "part", "b", F.col("query").alias("asks")), ["len", "home", "part"])
                   .drop("home", "part"), "pivot-blocks")

    def seed(part: pd.DataFrame) -> pd.DataFrame:
        block, out = _Block(part), []
        for i in np.flatnonzero(part["query"].to_numpy()):
            best = block.best(block.v[i], block.squares[i], block.d[i], -np.inf, keep)
            least = float(best[-1][0]) if len(best) == keep else -np.inf
            out.append((part["c"].iat[i], part["b"].iat[i], part["len"].iat[i], block.v[i], block.squares[i], block.d[i], least,
                        [{"score": s, "id": x, "r": r} for s, x, r in best]))
        return pd.DataFrame(out, columns=["c", "b", "len", "v", "square", "d", "least", "found"])

    found = "array<struct<score:bigint,id:bigint,r:bigint>>"
    seeds = table.filter("asks").groupBy("b").applyInPandas(
        seed, f"c long, b long, len int, v array<double>, square double, d array<double>, least double, found {found}")
    seeds = landed(seeds, "seeds")
    counts = seeds.agg(F.count("*")).first()[0], blocks.count()
    chunks = [max(1, -(-n // size)) for n, size in zip(counts, (QUERIES, SUMMARIES))]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = seeds.select("c", "b", "len", "square", "d", "least", F.pmod(F.xxhash64("c"), F.lit(chunks[0])).cast("int").alias("i"),
                          each(chunks[1]).alias("j"))
    held = blocks.select("b", "len", "low", "high", "square", F.pmod(F.xxhash64("b"), F.lit(chunks[1])).cast("int").alias("j"),
                         each(chunks[0]).alias("i"))

    def visits(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, mine in queries.groupby("len", sort=False):
            there = own[own["len"] == length]
            if not len(there):
                continue
            d = matrix(mine["d"])
            low, high = (matrix(there[x])[:, :d.shape[1]] for x in ("low", "high"))
            squares, names = there["square"].to_numpy(), there["b"].to_numpy()
            for away, c, home, square, least, i in zip(d, mine["c"], mine["b"], mine["square"], mine["least"], mine["i"]):
                apart = np.maximum(0, np.maximum(low - away, away - high)).max(axis=1)
                go = (limits(square, squares, apart) >= least) & (names != home)
                out += [(b, i, c) for b in names[go].tolist()]
        return pd.DataFrame(out, columns=["b", "i", "c"])

    pairs = asking.groupBy("i", "j").cogroup(held.groupBy("i", "j")).applyInPandas(visits, "b long, i int, c long")
    pairs = landed(pairs, "visits")
    guests = pairs.join(seeds.select("c", "v", "square", "d", "least"), "c")
    wanted = pairs.select(F.col("b").alias("at"), F.col("i").alias("chunk")).distinct()
    hosts = table.select(F.col("b").alias("at"), "v", "square", "d", "rows").join(wanted, "at")

    def evaluate(guests_: pd.DataFrame, hosts_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(guests_):
            block = _Block(hosts_)
            for c, q, square, away, least in zip(*(guests_[x] for x in ("c", "v", "square", "d", "least"))):
                best = block.best(np.asarray(q), square, np.asarray(away), least, keep)
                out += [(c, *x) for x in best]
        return pd.DataFrame(out, columns=["c", "score", "id", "r"]).astype({"id": "Int64"})

    more = guests.groupBy("b", "i").cogroup(hosts.groupBy("at", "chunk")).applyInPandas(
        evaluate, "c long, score long, id long, r long")
    every = seeds.select("c", F.explode("found").alias("f")).select("c", "f.*").unionByName(more)
    ahead = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("r")]
    best = every.withColumn("no", F.row_number().over(W.partitionBy("c").orderBy(*ahead))).filter(F.col("no") <= keep)
    best = landed(best.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("no", "id", "r", "score"))).alias("best")), "best")
    named = classes.filter("query").select("v", "c").join(best, "c").drop("c")
    answers = keyed.filter("query").join(named, "v").select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda x: x["r"] != F.col("r")), 1, k)).alias("at", "x"))
    return answers.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each length that fills more than a block: vectors of least hash, few enough for PIVOT_BYTES."""
    sizes = classes.groupBy("len").agg(F.count("*").alias("m")).filter((F.col("m") > BLOCK) & (F.col("len") > 0))
    room = sizes.agg(F.sum("len")).first()[0]
    if not room:
        return {}
    each = min(PIVOTS, PIVOT_BYTES // (8 * room))
    order = W.partitionBy("len").orderBy(F.xxhash64("c"))
    drawn = classes.join(sizes, "len").select("len", "v", F.row_number().over(order).alias("no")).filter(F.col("no") <= each)
    out: dict[int, list] = {}
    for r in drawn.collect():
        out.setdefault(r.len, []).append(r.v)
    return {length: matrix(v) for length, v in out.items()}
