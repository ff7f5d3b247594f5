"""Merkle manifest of a dataset, with a witness of every row built while rows are appended.

Rows are hashed to leaves where they lie; only leaves, never texts, are exchanged. The leaves of
a group, in order, are cut into aligned blocks, and a task appends a block's leaves one after
another. A subtree that is still open keeps the partial witnesses of the leaves below it; when
the last of its siblings is complete, each of them is extended by the others of its run. The
block's root is then a further append, one round up, and so on until a group has one node.
Witnesses of a round's nodes extend those of the round below, down to the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import landed

#: Nodes of a run that become one node, and levels of runs inside a block.
FAN, LEVELS = 16, 2
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Witnesses:
    """Appends nodes to a tree of ``levels`` levels and extends the witness of each.

    ``steps[i]`` is the witness of the i-th node so far: per level its run, as text, and its
    place in it. Runs are shared, so a node costs one reference a level.
    """

    def __init__(self, levels: int, fan: int = FAN):
        self.fan = fan
        self.steps: list[list[tuple[str, int]]] = []
        #: Per level the open run: digests of its complete nodes and the witnesses below each.
        self.open: list[list[tuple[str, list]]] = [[] for _ in range(levels)]

    def append(self, node: str) -> None:
        mine: list[tuple[str, int]] = []
        self.steps.append(mine)
        below = [mine]
        for level, run in enumerate(self.open):
            run.append((node, below))
            if len(run) < self.fan:
                return
            node, below = self._complete(level)
        self.root = node

    def _complete(self, level: int) -> tuple[str, list]:
        run, self.open[level] = self.open[level], []
        text, all_below = "".join(n for n, _ in run), []
        for place, (_, below) in enumerate(run):
            for witness in below:
                witness.append((text, place))
            all_below += below
        return digest(text), all_below

    def close(self) -> str:
        """Root: runs that are still open, however short, are complete."""
        for level, run in enumerate(self.open):
            if run:
                node, below = self._complete(level)
                if level + 1 < len(self.open):
                    self.open[level + 1].append((node, below))
                else:
                    self.root = node
        return self.root


def levels_of(n: int, fan: int = FAN) -> int:
    """Levels of runs over ``n`` nodes until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def block_tree(nodes: Sequence[str], n: int, fan: int, levels: int) -> tuple[str, list[list[tuple[str, int]]]]:
    """Root and witnesses of one block of a group with ``n`` nodes in all."""
    tree = Witnesses(min(levels, levels_of(n, fan)), fan)
    for node in nodes:
        tree.append(node)
    return tree.close(), tree.steps


def unfold(steps: Sequence[tuple[str, int]]) -> tuple[str, list[int]]:
    """Siblings, level by level and left to right, and per level place in and size of the run."""
    proof = "".join(run[:HEX * at] + run[HEX * (at + 1):] for run, at in steps)
    return proof, [x for run, at in steps for x in (at, len(run) // HEX)]


def fold(leaf: str, proof: str, path: Sequence[int]) -> str:
    """Root that ``leaf`` and the siblings of a witness give."""
    at = 0
    for place, of in zip(path[::2], path[1::2]):
        run = proof[at:at + HEX * (of - 1)]
        at += len(run)
        leaf = digest(run[:HEX * place] + leaf + run[HEX * place:])
    return leaf


def folded(leaf: Column, proof: Column, path: Column) -> Column:
    """:func:`fold` as a column; null where there is no witness."""

    @F.pandas_udf("string")
    def fold_all(leaf: pd.Series, proof: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else fold(x, p, q) for x, p, q in zip(leaf, proof, path)], dtype=object)

    return fold_all(leaf, proof, path)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    one = lambda f: F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256)


def _whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut anew, so that each part ends where a block ends."""
    rest = None
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if batch is None:
            if rest is not None:
                yield rest
            return
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        keys = list(zip(part["g"].to_pylist(), part["block"].to_pylist()))
        cut = len(keys) - 1
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)


def _blocks(part: pa.Table) -> Iterator[tuple[int, int]]:
    keys = list(zip(part["g"].to_pylist(), part["block"].to_pylist()))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _dealt(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {block}"))


def _in_order(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _up(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Nodes ``g, pos, n, digest`` of each round; in the last every group has one node."""
    block = fan**levels

    def roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches):
            g, at, n, nodes_ = (part[c].to_pylist() for c in ("g", "block", "n", "digest"))
            lines = [(g[a], at[a], -(-n[a] // block), block_tree(nodes_[a:b], n[a], fan, levels)[0]) for a, b in _blocks(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*lines), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["g", "pos", "n", "digest"])

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        dealt = _in_order(_dealt(rounds[-1].select("g", "pos", "n", "digest"), block))
        rounds.append(landed(dealt.mapInArrow(roots, "g string, pos long, n long, digest string"), "roots"))
    return rounds


def _down(rounds: list[DataFrame], above: DataFrame, fan: int, levels: int) -> DataFrame:
    """Nodes of the first round with ``proof``, ``path`` and ``mark``.

    ``above`` holds, per group at ``pos`` 0, what its one node's witness goes on with, and a
    mark that all leaves of the group take. A block's line of it leads the block.
    """
    block = fan**levels

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches):
            n, nodes, proof, path, mark = (part[c].to_pylist() for c in ("n", "digest", "proof", "path", "mark"))
            for a, b in _blocks(part):
                steps = block_tree(nodes[a + 1:b], n[a + 1], fan, levels)[1]
                for i, own in enumerate(steps, a + 1):
                    text, places = unfold(own)
                    proof[i], path[i], mark[i] = text + proof[a], places + path[a], mark[a]
            out = part.drop_columns(["block", "proof", "path", "mark"])
            for name, value, kind in (("proof", proof, pa.string()), ("path", path, pa.list_(pa.int32())), ("mark", mark, pa.string())):
                out = out.append_column(name, pa.array(value, kind))
            yield from out.filter(pc.greater_equal(out["pos"], 0)).combine_chunks().to_batches()

    for nodes in reversed(rounds[:-1] or rounds):
        heads = above.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "proof", "path", "mark")
        body = _dealt(nodes, block)
        both = body.unionByName(heads, allowMissingColumns=True)
        fields = [*nodes.schema.fields, T.StructField("proof", T.StringType()),
                  T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("mark", T.StringType())]
        above = _in_order(both).mapInArrow(extend, T.StructType(fields))
        if nodes is not rounds[0]:
            above = landed(above, "witnesses")
    return above


def in_groups(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place in group ``g`` along ``order``, and the group's size ``n``.

    Rows are dealt by ranges over group and order, so a group of any size takes as many tasks as
    it needs; a line per task and group gives the carry between them.
    """
    ranged = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    ranged = landed(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_p", F.shiftright("_at", 33))
    parts = ranged.groupBy("g", "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    before = W.partitionBy("g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = landed(parts.select(
        "g", "_p", (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_m").over(W.partitionBy("g")).alias("n")), "carry")
    placed = ranged.join(parts, ["g", "_p"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_p", "_shift")


def manifest(
    rows: DataFrame, id_: str, group: str, fields: Sequence[str], carry: dict[str, Column] | None = None,
    fan: int = FAN, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``rows``: its id, ``carry``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``path``.

    A leaf is the digest of ``fields`` (see :func:`leaf_digest`). Leaves of a group ascend by id,
    null ids first and equal ids by leaf; equal rows take neighbouring places. Every ``fan``
    consecutive nodes become the digest of their digests, until one, the subroot, remains;
    subroots in the order of their groups (the null group first, then by bytes) give ``root``
    alike. ``proof`` is the text of all siblings from the leaf to the root, ``path`` holds per
    level the place in the run and its size; :func:`folded` computes the root of them.

    Null and empty values and texts of any length are hashed as they are; an empty table has no
    rows and no root. ``carry`` names columns to hand on, computed on ``rows``; its names must not
    be those of the results. Other columns of ``rows``, however named, are not read. ``levels``
    (runs inside a block) changes the work's grain, not the result.
    """
    leaves = rows.select(
        F.struct(F.col(f"`{id_}`").alias("id"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),
        F.col(f"`{id_}`").alias("o"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"))
    leaves = landed(leaves.withColumn("r", F.monotonically_increasing_id()), "leaves")
    leaves = landed(in_groups(leaves, ["o", "digest", "r"]).drop("o", "r"), "leaves")
    rounds = _up(leaves, fan, levels)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    subroots = landed(in_groups(subroots, ["key"]), "subroots")
    top = _up(subroots, fan, levels)
    found = top[-1].select("digest").first()
    root = F.lit(found[0] if found else None).cast("string")
    none = F.array().cast("array<int>")
    over = top[-1].select("g", "pos", F.lit("").alias("proof"), none.alias("path"), F.lit("").alias("mark"))
    ends = _down(top, over, fan, levels)
    ends = landed(ends.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "proof", "path",
                              F.col("digest").alias("mark")), "witnesses")
    done = _down(rounds, ends, fan, levels)
    return done.select(
        F.col("row.id").alias(id_), *[F.col("row")[k].alias(k) for k in carry or {}], F.col("digest").alias("leaf"),
        F.col("mark").alias("subroot"), root.alias("root"), "proof", "path")
