"""The operators' queries over the data tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    decontaminate,
    licences,
    merkle,
    metric_join,
    mixing,
    odd_sketches,
    pca_clusters,
    pivot_search,
    secrets,
    sharding,
    sql,
    suffix_runs,
    token_counts,
    toxicity,
)
from panelwright.llm.common import small_batches, word_count
from panelwright.sources.tables import read_table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, "documents").select("doc_id", *columns)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases and covered licence templates of every document."""
    docs = licences.scan_licences(documents(spark, sf_dir, "text"), "text")
    starts = F.transform("licences.base", lambda b: b["start"])
    spans = F.transform("licences.spans", lambda s: s["label"])
    base = F.transform("licences.base", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("licences.spans", lambda s: s["coverage"]))
    return docs.select(
        "doc_id", F.col("licences.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, spans)).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that documents hold: one row per document and passage."""
    docs = documents(spark, sf_dir, "text")
    items = read_table(spark, sf_dir, "benchmark")
    found = decontaminate.find_leaks(docs, "text", items, "item_id", "text")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), *[F.col(f"leak.{c}").alias(c) for c in ("start", "stop", "edits", "windows")])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network that the labelled rows train."""
    docs = documents(spark, sf_dir, "text")
    fitted = toxicity.fit(docs, "doc_id", "text", read_table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.score(docs, "text", fitted)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    docs = documents(spark, sf_dir, "text")
    found = odd_sketches.near_duplicates(docs, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(documents(spark, sf_dir), "doc_id", SHARDS)


def _written(spans) -> object:
    lines = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(lines, ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    docs = secrets.find_secrets(documents(spark, sf_dir, "text"), "text")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE))
    return docs.select(
        "doc_id", *[number(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = documents(spark, sf_dir, "source", "text")
    drawn = mixing.draw(docs, "source", word_count(F.col("text")), ["doc_id", "text"])
    return drawn.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.size("_shards")).alias("taken"),
        F.col("_shards").alias("shards"),
    )


def tokenizer_spec(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it passes 2,048 tokens."""
    docs = documents(spark, sf_dir, "text")
    counted = token_counts.count_tokens(docs, "text", tokenizer_spec())
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding among those of its label."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return metric_join.range_join(rows, "vec_id", "embedding", "label").select("vec_id", "n_links", "component_id", "kept")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document repeated strings of 200 bytes cover, and the digest of the rest."""
    docs = suffix_runs.without_repeats(documents(spark, sf_dir, "text"), "text")
    return docs.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and the root that a tampered fifth of them gives."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = documents(spark, sf_dir, *fields[1:])
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest([*map(F.col, fields[:-1]), lower]))
    found = merkle.manifest(docs, "doc_id", "source", fields, {"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer products with each fiftieth embedding."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivot_search.top_products(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding around 16 centroids after three rounds."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return pca_clusters.clusters(rows, "embedding", start).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_embeddings": op9_embeddings,
    "op10_suffixes": op10_suffixes,
    "op11_manifest": op11_manifest,
    "op12_nearest": op12_nearest,
    "op13_clusters": op13_clusters,
}
SQL: dict[str, str] = {
    "op4_near_duplicates": sql.near_duplicates(),
    "op5_sharding": sql.shard_places(SHARDS),
    "op6_secrets": sql.secret_spans(),
    "op9_embeddings": sql.EMBEDDINGS,
    "op10_suffixes": sql.repeats(),
    "op11_manifest": sql.manifest(),
    "op12_nearest": sql.NEAREST,
    "op13_clusters": sql.clusters(),
}
