"""What a table of text columns really holds, and whether codes and labels agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.ordering import null_safe_join
from panelwright.operators.profile import one_pass

#: Observed types from the narrowest to the widest; a column's type is the narrowest that holds all.
LADDER = ("null", "integer", "decimal", "date", "text")
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+[eE][+-]?[0-9]+)$"
DATE = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$"


def observed_type(c: Column) -> Column:
    """Type that the value itself has; blank text counts as null."""
    value = F.trim(c.cast("string"))
    return (
        F.when(value.isNull() | (value == ""), "null")
        .when(value.rlike(INTEGER), "integer").when(value.rlike(DECIMAL), "decimal")
        .when(value.rlike(DATE), "date").otherwise("text")
    )


def schema_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, nulls, integers, decimals, dates, texts, observed, example, all_null) per column.

    ``observed`` is the narrowest type that holds every value: integers and decimals together
    are decimal, dates with anything else but nulls are text. ``example`` is the least value of
    the kind that decides. Counts fold map-side, in one pass over all columns.
    """
    columns = list(columns or df.columns)
    kind = lambda c, name: observed_type(c) == name
    stats = {f"{name}s": lambda c, name=name: F.count_if(kind(c, name)) for name in LADDER}
    stats |= {f"example_{name}": lambda c, name=name: F.min(F.when(kind(c, name), F.trim(c.cast("string")))) for name in LADDER[1:]}
    table = one_pass(df, columns, {"rows": lambda c: F.count(F.lit(1)), **stats})
    some = lambda name: F.col(f"{name}s") > 0
    observed = (
        F.when(some("text") | (some("date") & (some("integer") | some("decimal"))), "text")
        .when(some("date"), "date").when(some("decimal"), "decimal").when(some("integer"), "integer").otherwise("null")
    )
    widest = F.coalesce(*[F.col(f"example_{name}") for name in reversed(LADDER[1:])])
    return table.select(
        "column", "rows", *[f"{name}s" for name in LADDER], observed.alias("observed"), widest.alias("example"),
        (F.col("nulls") == F.col("rows")).alias("all_null"))


def align_codes(labels: DataFrame, codes: DataFrame, key: str, label: str, code: str) -> DataFrame:
    """(label, code, rows, first_key, codes_of_label, labels_of_code, status) over two tables.

    ``labels`` and ``codes`` hold the same rows, by ``key``, one with text and one with numbers.
    A pair is ``aligned`` if neither side has another partner; else ``label_has_codes``,
    ``code_has_labels`` or ``both``. Values whose key the other table lacks, or whose partner is
    null, are ``only_label`` or ``only_code``. ``first_key`` is the least key of the pair, which
    restores the order of the rows. Blank labels count as null. Rows are counted per pair
    before pairs are compared, so a value that most rows hold is one row.
    """
    text = F.trim(F.col(label).cast("string"))
    left = labels.select(F.col(key).alias("_k"), F.when(text != "", text).alias("label"))
    right = codes.select(F.col(key).alias("_key"), F.col(code).alias("code"))
    both = left.join(right, F.col("_k") == F.col("_key"), "full").withColumn("_at", F.coalesce("_k", "_key"))
    pairs = both.filter("label is not null or code is not null").groupBy("label", "code").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first_key"))
    whole = pairs.filter("label is not null and code is not null")
    pairs = null_safe_join(pairs, whole.groupBy("label").agg(F.count(F.lit(1)).alias("codes_of_label")), ["label"], "left")
    pairs = null_safe_join(pairs, whole.groupBy("code").agg(F.count(F.lit(1)).alias("labels_of_code")), ["code"], "left")
    many, shared = F.col("codes_of_label") > 1, F.col("labels_of_code") > 1
    status = (
        F.when(F.col("code").isNull(), "only_label").when(F.col("label").isNull(), "only_code")
        .when(many & shared, "both").when(many, "label_has_codes").when(shared, "code_has_labels").otherwise("aligned")
    )
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pairs.select("label", "code", "rows", "first_key", number("codes_of_label"), number("labels_of_code"), status.alias("status"))
