"""The Merkle manifest against a plain tree, and its defined results on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelwright.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(nodes, fan):
    """Root of a list of digests, and per node its siblings level by level with its places."""
    proof, path, at = [""] * len(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for i, x in enumerate(at):
            run, place = runs[x // fan], x % fan
            proof[i] += "".join(run[:place] + run[place + 1:])
            path[i] += [place, len(run)]
        at, nodes = [x // fan for x in at], [H("".join(r)) for r in runs]
    return nodes[0], list(zip(proof, path))


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 26, 27])
def test_appends_extend_partial_witnesses(n):
    nodes = [H(str(i)) for i in range(n)]
    tree = merkle.Witnesses(merkle.levels_of(n, 3), 3)
    for node in nodes:
        tree.append(node)
    early = [len(s) for s in tree.steps]
    root, witnesses = plain(nodes, 3)
    assert tree.close() == root and [merkle.unfold(s) for s in tree.steps] == witnesses
    assert all(merkle.fold(x, *w) == root for x, w in zip(nodes, witnesses))
    if n == 10:  # the first nine have theirs up to the open top run, the last one none yet
        assert early == [2] * 9 + [0]


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize(("fan", "levels"), [(16, 2), (3, 1), (2, 3)])
def test_manifest_against_a_plain_tree(spark, fan, levels):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.choice(["a", "a", "a", "b", "é", "Z", None]), rng.choice([None, "", "Text É", "y" * 5000])) for _ in range(300)]
    rows += [(None, "a", "x"), (None, None, None), (7, "a", "same"), (7, "a", "same"), (8, "", "empty name"), (5, "lone", "l")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, source string, text string, leaf int, proof int")
    carry = {"mark": F.length("text")}
    got = merkle.manifest(docs.repartition(7), "id", "source", ["id", "text"], carry, fan, levels)
    got = got.withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"), F.col("path"))).collect()
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i is not None, i or 0, H(part(i) + part(text)), text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in order]
    root, tops = plain([t[0] for t in trees], fan)
    want = []
    for s, (subroot, own), (proof, path) in zip(order, trees, tops):
        for (there, i, leaf, text), (p, q) in zip(sorted(groups[s], key=lambda x: x[:3]), own):
            want.append((str(i if there else None), str(None if text is None else len(text)), leaf, subroot, root, p + proof, q + path, root))
    assert sorted((str(r.id), str(r.mark), r.leaf, r.subroot, r.root, r.proof, r.path, r.again) for r in got) == sorted(want)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(3, None, "t")], "id long, source string, text string")
    r, = merkle.manifest(docs, "id", "source", ["text"]).collect()
    assert r.leaf == r.subroot == r.root == H("1:t") and r.proof == "" and r.path == []
    assert merkle.manifest(docs.limit(0), "id", "source", ["text"]).count() == 0


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    docs = spark.range(40).select("id", F.lit("s").alias("source"), F.lit("t").alias("text"))
    found = merkle.manifest(docs, "id", "source", ["id", "text"])
    folded = merkle.folded(F.when(F.col("id") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")), F.col("proof"), F.col("path"))
    assert [r.id for r in found.withColumn("f", folded).filter("f != root").collect()] == [7]
