"""The stages one after another on a small folder, and what each must keep."""

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, odd_sketches

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.landed(stage(spark, out[-1], FOLDER), name))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]


def test_columns_stay_until_the_last(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "slot", "shard"]


def test_each_stage_decides(spark, steps):
    docs, clean, single, free, mix, placed = steps
    assert set(r.doc_id for r in clean.collect()) <= set(r.doc_id for r in docs.collect())
    groups = odd_sketches.near_duplicates(clean, "doc_id", "text", percent=80, width=5)
    assert sorted(r.id for r in groups.filter("kept").collect()) == sorted(r.doc_id for r in single.collect())
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    left = decontaminate.find_leaks(free, "text", items, "item_id", "text", out="l").filter("size(l) > 0")
    assert left.count() == 0 and free.count() <= single.count()
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in free.collect()}
    assert placed.count() == mix.count()
    assert placed.groupBy("doc_id").agg({"shard": "min", "slot": "max"}).count() == len(counts)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one two three four five six", None, None, 3),
     (3, "one two three four five six", "en", "b", 3), (None, "long " * 30_000, "en", "b", 1)],
])
def test_stages_on_empty_and_odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.landed(stage(spark, docs, FOLDER), "odd")
    assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 2} and (docs.count() > 0) == bool(rows)


CLASHES = "_slot string, _shard string, _name string, _draws string, _copy string, _toxic string, _leaks string, _size string, _s string, _block string, row string"


def test_stages_hand_on_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    names = [c.split(" ")[0] for c in CLASHES.split(", ")]
    rows = [(i, f"some words of text number {i} stand here", "en", "ab"[i % 2], 3, *[f"{c}{i}" for c in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.landed(stage(spark, docs, FOLDER), "clash")
    assert docs.columns[:-2] == schema.replace(" long", "").replace(" string", "").split(", ") and docs.columns[-2:] == ["slot", "shard"]
    got = docs.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_operators_hand_on_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (2, "b", None, "z")], "doc_id long, source string, _slot string, _shard string")
    placed = corpus_pipeline.sharding.place(docs, "doc_id", ["s0", "s1"], 11)
    assert placed.columns == [*docs.columns, "slot", "shard"] and {(r._slot, r._shard) for r in placed.collect()} == {("x", "y"), (None, "z")}
    named = docs.selectExpr("doc_id", "source", "'n' as _name", "'d' as _draws", "'c' as _copy", "'s' as _s", "'b' as _block", "'r' as row")
    drawn = corpus_pipeline.mixing.draw(named, "source", F.lit(3), ["doc_id"])
    assert drawn.columns == [*named.columns, *corpus_pipeline.mixing.RESULTS]
    assert {(r._name, r._draws, r._copy, r._s, r._block, r.row) for r in drawn.collect()} == {tuple("ndcsbr")}


def test_one_row_of_a_group_stays_without_ids_and_with_repeated_ones(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, end]) for end in ("a", "b", "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for ids in ([None, None, None], [4, 4, 9], [None, 7, None]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, near)], schema)
        left = corpus_pipeline.deduplicated(spark, docs, FOLDER).collect()
        assert len(left) == 1 and left[0].doc_id == min((i for i in ids if i is not None), default=None)
