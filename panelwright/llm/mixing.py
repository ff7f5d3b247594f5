"""Mixing sources to target weights by exact quotas of permuted blocks.

The rows of a source are cut by a seeded hash into blocks. A source takes whole passes over its
blocks and part of one more, so its number of block draws is exact. A tree of multivariate
hypergeometric draws splits those quotas among the output shards: a node deals its blocks to
its two halves, down to single shards. A shard then owns a range of each source's permuted
block sequence, and no block draw belongs to two shards; inside a shard rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import landed

#: Block tables up to this many bytes are broadcast, larger ones shuffled; bytes of a block's row.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64
#: Leading bits of a row's hash by which the cut block of a source is cut again.
CUT_BITS = 12
#: Columns that a draw adds.
RESULTS = ("_size", "_source_size", "_target", "_shards", "_u")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``limit`` times its size, the excess reshared."""
    out, left = [0.0] * len(sizes), float(total)
    open_ = list(range(len(sizes)))
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if weight <= 0 or left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = limit * sizes[i]
        left -= math.fsum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def cycle(values: Sequence[float], n: int) -> list[float]:
    return [values[i % len(values)] for i in range(n)]


def split_path(quota: Sequence[int], shards: int, shard: int, seed: int) -> list[tuple[int, int]]:
    """``(start, stop)`` of ``shard`` in each source's block sequence.

    Every node of the tree draws from a generator seeded by its own range of shards, so the
    paths of two shards agree on the nodes they share, wherever each is computed.
    """
    lo, hi, start, count = 0, shards, np.zeros(len(quota), np.int64), np.array(quota, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng, rest, left = np.random.default_rng([seed, lo, hi]), int(count.sum()), np.zeros_like(count)
        need = rest * (mid - lo) // (hi - lo)
        for i, n in enumerate(count):  # one source after another: the marginals of the joint draw
            rest -= int(n)
            left[i] = rng.hypergeometric(n, rest, need) if need and n else 0
            need -= int(left[i])
        if shard < mid:
            hi, count = mid, left
        else:
            lo, start, count = mid, start + left, count - left
    return [(int(a), int(a + n)) for a, n in zip(start, count)]


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """Factor and shift of a permutation ``i -> (factor * i + shift) mod n``."""
    factor = int(rng.integers(1, max(2, n)))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor % max(n, 1), int(rng.integers(0, max(1, n)))


def draw(
    docs: DataFrame, source: str, size: Column, identity: Sequence[Column], *, weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5, limit: int = 2, shards: int = 64, blocks: int = 4096, seed: int = 20_240,
) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target``, ``_shards`` (the shard of each copy taken) and ``_u``.

    ``weights`` repeat over the sources by code point, null last; together they take ``total``
    times all sizes, each at most ``limit`` times its own. ``identity`` columns, hashed to
    ``_u``, order the rows of a source; rows equal in all of them are taken together. A
    source's taken size misses its target by at most half of one such unit, and no row is
    taken more than ``limit`` times.

    The driver holds one line per source. A source's rows spread over ``blocks`` blocks, so a
    source with a third of all rows is no hot key; of the one block that a quota cuts, only the
    part where it ends, 1/4096 by the next bits, is ordered row by row. Null sizes count 0; an
    empty table gives an empty one; columns named as the results are replaced, all others pass
    through.
    """
    drawn = _draw(docs, source, size, identity, weights, total, limit, shards, blocks, seed)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in RESULTS]
    return drawn.select(*kept, *RESULTS)


def _draw(
    docs: DataFrame, source: str, size: Column, identity: Sequence[Column], weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5, limit: int = 2, shards: int = 64, blocks: int = 4096, seed: int = 20_240,
) -> DataFrame:
    """:func:`draw` with the caller's columns in a struct ``row``, where no name can clash."""
    spark = docs.sparkSession
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("_of"),
        F.xxhash64(F.lit(seed), *identity).alias("_u"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"))
    base = base.withColumn("_block", F.pmod("_u", F.lit(blocks)))
    stats = landed(base.groupBy(F.col("_of").alias("_name"), "_block").agg(F.sum("_size").alias("_words")), "blocks")
    found = stats.groupBy("_name").agg(F.sum("_words").alias("n")).collect()
    found.sort(key=lambda r: (r._name is None, r._name or ""))
    sums = [r.n for r in found]
    goal = targets(sums, cycle(weights, len(sums)), total * sum(sums), limit)
    passes = [min(limit, int(g // n)) if n else 0 for g, n in zip(goal, sums)]
    turn = np.random.default_rng(seed)
    moves = [[_permutation(blocks, turn) for _ in range(limit + 1)] for _ in found]
    plan = F.broadcast(spark.createDataFrame(
        [(i, r._name, p, float(g - p * r.n), r.n, float(g), m) for i, (r, p, g, m) in enumerate(zip(found, passes, goal, moves))],
        "_s int, _name string, _passes long, _rest double, _source_size long, _target double, "
        "_moves array<struct<by: bigint, shift: bigint>>",
    ))
    table = stats.join(plan, stats["_name"].eqNullSafe(plan["_name"])).drop("_name", "_source_size", "_target")
    at = F.expr(f"pmod(_moves[cast(e AS int)].by * _block + _moves[cast(e AS int)].shift, {blocks}L)")
    full = table.filter("_passes > 0").withColumn("e", F.explode(F.expr("sequence(0L, _passes - 1)"))).withColumn("at", at)
    last = table.withColumn("e", F.col("_passes")).withColumn("at", at)
    until = F.sum("_words").over(W.partitionBy("_s").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("until", until).filter(F.col("until") - F.col("_words") < F.col("_rest"))
    # Of the block in which the quota ends, ``cut`` is what is still to be taken.
    last = last.withColumn("cut", F.when(F.col("until") > F.col("_rest"), F.col("_rest") - F.col("until") + F.col("_words")))
    drawn = full.withColumn("cut", F.lit(None).cast("double")).select("_s", "_block", "e", "at", "cut").unionByName(
        last.select("_s", "_block", "e", "at", "cut"))
    drawn = landed(
        drawn.withColumn("seq", F.row_number().over(W.partitionBy("_s").orderBy("e", "at")).cast("long") - 1), "draws")
    quota = {r._s: r.n for r in drawn.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    quotas = [quota.get(i, 0) for i in range(len(found))]

    def ranges(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                own = enumerate(split_path(quotas, shards, int(shard), seed))
                yield pd.DataFrame([(i, shard, a, b) for i, (a, b) in own if b > a], columns=["_s", "shard", "start", "stop"])

    owned = (
        spark.range(shards).mapInPandas(ranges, "_s int, shard int, start long, stop long")
        .select("_s", "shard", F.explode(F.expr("sequence(start, stop - 1)")).alias("seq"))
    )
    names = plan.select("_s", "_name", "_source_size", "_target")
    keyed = base.join(names, F.col("_of").eqNullSafe(F.col("_name")), "left").drop("_name", "_of")
    stop = _stops(keyed, drawn.filter("cut is not null").select("_s", "_block", "cut"))
    draws = landed(
        drawn.join(owned, ["_s", "seq"]).join(stop, ["_s", "_block"], "left").groupBy("_s", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("e", "shard", F.col("cut").isNull().alias("whole"), "stop"))).alias("_draws")),
        "owners",
    )
    if len(found) * blocks * ROW_BYTES <= BROADCAST_BYTES:
        draws = F.broadcast(draws)
    taken = F.expr("transform(filter(coalesce(_draws, array()), d -> d.whole or _u <= d.stop), d -> d.shard)")
    return keyed.join(draws, ["_s", "_block"], "left").select(
        "row", "_size", "_source_size", "_target", taken.alias("_shards"), "_u")


def _stops(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per source's cut block the last hash whose unit lies in the quota by more than half.

    Units lie in order of their hash. Sums by its leading bits show where the quota ends, and
    only the units there are ordered one by one.
    """
    units = keyed.join(F.broadcast(cuts), ["_s", "_block"]).groupBy("_s", "_block", "cut", "_u").agg(F.sum("_size").alias("n"))
    units = landed(units.withColumn("lead", F.shiftright("_u", 64 - CUT_BITS)), "units")
    ahead = W.partitionBy("_s", "_block").orderBy("lead")
    parts = units.groupBy("_s", "_block", "cut", "lead").agg(F.sum("n").alias("m"), F.max("_u").alias("top"))
    parts = parts.withColumn("before", F.sum("m").over(ahead.rowsBetween(W.unboundedPreceding, 0)) - F.col("m"))
    parts = parts.withColumn("earlier", F.lag("top").over(ahead)).filter("before < cut")
    ends = parts.groupBy("_s", "_block").agg(F.max_by(F.struct("lead", "before", "earlier"), "lead").alias("x")).select("_s", "_block", "x.*")
    order = W.partitionBy("_s", "_block").orderBy("_u").rowsBetween(W.unboundedPreceding, 0)
    inside = units.join(F.broadcast(ends), ["_s", "_block", "lead"]).withColumn(
        "mid", F.col("before") + F.sum("n").over(order) - F.col("n") / 2)
    return inside.groupBy("_s", "_block").agg(
        F.coalesce(F.max(F.when(F.col("mid") < F.col("cut"), F.col("_u"))), F.max("earlier")).alias("stop"))


def mix(
    docs: DataFrame, source: str, size: Column, identity: Sequence[Column], *, seed: int = 20_240, shard: str = "_shard", **how
) -> DataFrame:
    """One row per copy taken, dealt to its shard and shuffled there; ``docs`` columns and ``shard``.

    Arguments and defined results as for :func:`draw`; a column named ``shard`` is replaced, all
    others pass through.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != shard]
    copies = _draw(docs, source, size, identity, seed=seed, **how).select("row", "_u", F.posexplode("_shards").alias("_copy", "_shard"))
    place = F.xxhash64(F.lit(seed + 1), "_u", "_copy")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = copies.repartition(int(n), "_shard", F.pmod(place, F.lit(16))).sortWithinPartitions("_shard", place)
    return dealt.select(*kept, F.col("_shard").alias(shard))
