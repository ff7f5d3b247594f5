"""JSON explanation cases and the nested read of operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CASE_SCHEMA = T.StructType(
    [
        T.StructField("patient_id", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("shap_values", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("timestamp", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_cases(
    spark: SparkSession,
    folder: str,
    mode: str = "artifact",
    require_values: bool = False,
    lines: bool = False,
    pattern: str | None = None,
) -> DataFrame:
    """(case_id, explanation, attributions, timestamp) from ``case_*`` or ``runtime_*`` files.

    One case per file, or one per line with ``lines``: millions of cases are better kept as
    lines of few files. The id defaults to the file's stem. With ``require_values`` a case
    without attributions stops the job, naming its file.
    """
    prefix = {"artifact": "case", "runtime": "runtime"}.get(mode)
    if prefix is None:
        raise ValueError("mode must be 'artifact' or 'runtime'")
    options = {
        "multiLine": "false" if lines else "true",
        "pathGlobFilter": pattern or f"{prefix}_*.json",
        "mode": "PERMISSIVE",
    }
    raw = (
        spark.read.schema(CASE_SCHEMA)
        .options(**options)
        .json(folder)
        .select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("_stem"))
    )
    bad = F.col("_corrupt_record").isNotNull()
    if require_values:
        bad = bad | F.col("shap_values").isNull()
    problem = F.concat(F.lit("unusable case file: "), F.col("_stem"))
    checked = raw.withColumn("_stem", F.when(bad, F.raise_error(problem)).otherwise(F.col("_stem")))
    return checked.select(
        F.coalesce("patient_id", "_stem").alias("case_id"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.coalesce("shap_values", F.create_map().cast("map<string,double>")).alias("attributions"),
        "timestamp",
    )


def attribution_rows(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("attributions").alias("feature", "value"))


def child_array(df: DataFrame, entity: str, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """(entity, name): ordered array of child structs.

    For children the domain bounds per entity, such as one record per step; unbounded
    children stay rows.
    """
    item = F.struct(*order, *[f for f in fields if f not in order])
    return df.groupBy(entity).agg(F.array_sort(F.collect_list(item)).alias(name))


def nested_documents(parents: DataFrame, entity: str, children: Sequence[DataFrame]) -> DataFrame:
    """One document per entity with its child arrays; an entity without children has null."""
    out = parents
    for child in children:
        out = out.join(child, entity, "left")
    return out


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(c, path).try_cast(kind)


def search_entities(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Case-blind substring search over names or identifiers."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(query.lower())
    return df.filter(hit)
