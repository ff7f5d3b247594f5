"""A cleaning run over ``documents`` in stages, each by one operator of ``panelwright.llm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, mixing, odd_sketches, sharding, toxicity
from panelwright.llm.common import free_name, landed, small_batches, word_count
from panelwright.llm.queries import SHARDS
from panelwright.sources.tables import read_table


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, doesn't call toxic."""
    small_batches(spark)
    fitted = toxicity.fit(docs, "doc_id", "text", read_table(spark, sf_dir, "labels"), "toxic")
    name = free_name(docs, "_toxic")
    return toxicity.score(docs, "text", fitted, name).filter(F.col(name) < 0.5).select(*columns(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id, null ids last.

    Shingles of five words and a similarity of 0.8, the pipeline's default. Of equal ids the
    text's digest decides. Rows equal in id and text are one; rows without words are no one's
    duplicates.
    """
    small_batches(spark)
    found = odd_sketches.near_duplicates(docs, "doc_id", "text", percent=80, width=5)
    stay = found.filter("first").select(F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    keyed = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("_d"), "text")
    keyed = odd_sketches.text_keys(keyed, "text")
    same = keyed["_d"].eqNullSafe(stay["_id"]) & (keyed["t1"] == stay["_t1"]) & (keyed["t2"] == stay["_t2"])
    once = keyed.join(stay.distinct(), same, "left_semi").dropDuplicates(["_d", "t1", "t2"])
    return once.select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    small_batches(spark)
    items = read_table(spark, sf_dir, "benchmark")
    name = free_name(docs, "_leaks")
    found = decontaminate.find_leaks(docs, "text", items, "item_id", "text", out=name)
    return found.filter(F.size(name) == 0).select(*columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix of sources takes them: none, once or twice each."""
    name = free_name(docs, "_shard")
    mix = mixing.mix(docs, "source", word_count(F.col("text")), ["doc_id", "text"], shard=name)
    return mix.select(*columns(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the shard that each belongs to."""
    return sharding.place(docs, "doc_id", SHARDS)


STAGES = [
    ("toxicity", not_toxic),
    ("near-duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Trained scores and seeded draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each landed before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
