"""Scoring written explanations against attribution tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from panelwright import fixed_values as V
from panelwright.operators.windows import last_rows

#: Texts that a task holds as Python strings at a time.
SEEK_ROWS = 1000


def truth_rows(attributions: DataFrame, k: int = 5, case: str = "case_id") -> DataFrame:
    """Top-k features per case by absolute value: sign, rank and magnitude band."""
    if k < 1:
        raise ValueError("k must be at least 1")
    sized = attributions.withColumn("abs_value", F.abs("value"))
    top = last_rows(sized, case, [F.desc("abs_value"), F.asc("feature")], k, name="rank")
    gathered = top.groupBy(case).agg(
        F.max("abs_value").alias("_max"),
        F.collect_list(F.struct("feature", "value", "abs_value", "rank")).alias("_rows"),
    )
    flat = gathered.select(case, "_max", F.inline("_rows"))
    return flat.select(
        case,
        "feature",
        F.when(F.col("value") >= 0, "increase").otherwise("decrease").alias("sign"),
        "abs_value",
        "rank",
        F.when(F.col("abs_value") >= V.STRONG_SHARE * F.col("_max"), "strong")
        .otherwise("moderate")
        .alias("magnitude_band"),
    )


def _escaped(phrase: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else f"\\{ch}" for ch in phrase)


#: A letter, number or underscore of any script: what continues a word.
_WORD = r"[\p{L}\p{N}_]"


def _whole(phrase: str) -> str:
    """The phrase as whole words. The look behind follows the phrase, so a search can skip ahead to its letters."""
    p = _escaped(phrase)
    return f"{p}(?<!{_WORD}{p})(?!{_WORD})"


def _inside(short: str, phrase: str) -> bool:
    """Whether ``phrase`` holds the whole words of ``short`` and more."""
    return short != phrase and f" {short} " in f" {phrase} "


def _states(text: Column, phrases: Sequence[str]) -> Column:
    """Whether ``text`` holds any phrase as whole words.

    A phrase that holds another one's words adds nothing. Phrases that begin a longer one are sought first,
    and the patterns only where that beginning occurs at all.
    """
    least = [p for p in phrases if not any(_inside(q, p) for q in phrases)]
    stems = [p for p in least if not any(q != p and p.startswith(q) for q in least)]
    found = []
    for stem in stems:
        whole = [text.rlike(_whole(p)) for p in least if p.startswith(stem)]
        found.append(text.contains(stem) & reduce(Column.__or__, whole))
    return reduce(Column.__or__, found) if found else text.rlike(_whole(""))


def claims(
    texts: DataFrame,
    text: str,
    case: str,
    vocabulary: Sequence[str] = V.KNOWN_FEATURES,
    increase: Sequence[str] = V.INCREASE_PHRASES,
    decrease: Sequence[str] = V.DECREASE_PHRASES,
    mixed: Sequence[str] = V.MIXED_PHRASES,
    magnitudes: Sequence[tuple[str, str]] = V.MAGNITUDE_WORDS,
    context_chars: int = V.CLAIM_CONTEXT_CHARS,
) -> DataFrame:
    """(case, feature, direction, magnitude, position) stated in each text.

    A feature counts where it first occurs; the words around it give direction (increase
    before decrease before mixed) and magnitude. The names are sought in the whole text; a
    mention takes only the words around it along, and the phrases are sought in those. The
    direction of a mention is worked out once, as an array that is empty without one; its
    magnitude is a column of the claim, which a query that doesn't read it leaves out.
    """
    lowered = texts.select(F.col(case), F.make_valid_utf8(F.lower(F.col(text))).alias("_t"))
    around = F.col("around")
    direction = (
        F.when(_states(around, increase), "increase")
        .when(_states(around, decrease), "decrease")
        .when(_states(around, mixed), "mixed")
    )
    told = mentions(lowered, "_t", case, vocabulary, context_chars).select(
        "*", F.explode(F.array_compact(F.array(direction))).alias("direction"))
    size = F.when(F.lit(False), "")
    for word, label in magnitudes:
        size = size.when(_states(around, [word]), label)
    return told.select(case, "feature", "direction", size.otherwise("unspecified").alias("magnitude"), "position")


def mentions(lowered: DataFrame, text: str, case: str, vocabulary: Sequence[str], context_chars: int) -> DataFrame:
    """(case, feature, position, around): where each name first stands in a lower-cased text, and the words there.

    Names are sought as substrings by Python's search, which skips most places of a text; Spark's
    compares at every place for every name.
    """
    names, sought = list(vocabulary), [name.lower() for name in vocabulary]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = pa.array(names, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, SEEK_ROWS):
                part = batch.slice(start, SEEK_ROWS)
                rows, which, places, words = [], [], [], []
                for row, told in enumerate(part.column(1).to_pylist()):
                    for i, name in enumerate(sought if told is not None else ()):
                        at = told.find(name)
                        if at >= 0:
                            rows.append(row)
                            which.append(i)
                            places.append(at + 1)
                            words.append(told[max(0, at - context_chars) : at + len(names[i]) + context_chars])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), features.take(pa.array(which, pa.int64())),
                     pa.array(places, pa.int32()), pa.array(words, pa.string())],
                    names=[case, "feature", "position", "around"])

    schema = StructType([lowered.schema[case]]).add("feature", StringType()).add("position", IntegerType()).add("around", StringType())
    return lowered.select(case, text).mapInArrow(seek, schema)


def coverage(claimed: DataFrame, cases: DataFrame, case: str, vocabulary_size: int = len(V.KNOWN_FEATURES)) -> DataFrame:
    """Per case: parse status, number of claims and share of the vocabulary claimed."""
    counted = claimed.groupBy(case).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return cases.select(case).join(counted, case, "left").select(
        case,
        F.when(n > 0, "ok").otherwise("parse_failed").alias("status"),
        n.cast("long").alias("claims"),
        (n / vocabulary_size).alias("coverage"),
    )


def canonical_name(
    name: Column,
    canonical: Sequence[str] = V.CANONICAL_FEATURES,
    aliases: Mapping[str, str] = V.FEATURE_ALIASES,
) -> Column:
    """Reporting name behind a spoken feature name; unknown names stay as they are."""
    table = {c.lower().replace("_", " "): c for c in canonical}
    table.update(aliases)
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    key = F.lower(F.replace(F.trim(name), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(lookup, key), name)


def score_cases(
    truth: DataFrame,
    claimed: DataFrame,
    cases: DataFrame,
    case: str = "case_id",
    weights: Mapping[str, float] = V.CASE_WEIGHTS,
    gates: Mapping[str, float] = V.CASE_GATES,
) -> DataFrame:
    """Feature F1, sign and magnitude accuracy, composite, gates and failure tags per case.

    ``claimed`` may name one feature twice after aliasing; the later mention counts.
    A case without truth and without claims passes.
    """
    last = claimed.groupBy(case, "feature").agg(
        F.max_by(F.struct("direction", "magnitude"), "position").alias("_claim")
    )
    both = truth.select(case, "feature", "sign", "magnitude_band").join(last, [case, "feature"], "full_outer")
    counted = both.groupBy(case).agg(
        F.count("sign").alias("n_truth"),
        F.count("_claim").alias("n_claim"),
        F.count_if(F.col("sign").isNotNull() & F.col("_claim").isNotNull()).alias("matched"),
        F.count_if(F.col("sign") == F.col("_claim.direction")).alias("signs"),
        F.count_if(F.col("magnitude_band") == F.col("_claim.magnitude")).alias("sizes"),
    )
    table = cases.select(case).join(counted, case, "left").fillna(
        0, ["n_truth", "n_claim", "matched", "signs", "sizes"]
    )
    empty = (F.col("n_truth") == 0) & (F.col("n_claim") == 0)
    f1 = F.try_divide(2.0 * F.col("matched"), (F.col("n_truth") + F.col("n_claim")).cast("double"))

    def measure(c: Column) -> Column:
        return F.when(empty, 1.0).otherwise(F.coalesce(c, F.lit(0.0)))

    matched = F.col("matched").cast("double")
    scored = table.select(
        case,
        measure(f1).alias("feature_f1"),
        measure(F.try_divide(F.col("signs").cast("double"), matched)).alias("sign_accuracy"),
        measure(F.try_divide(F.col("sizes").cast("double"), matched)).alias("magnitude_accuracy"),
    )
    composite = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    scored = scored.withColumn("composite", F.round(composite, 6))
    tags = F.array_compact(
        F.array(*[F.when(F.col(k) < gate, f"low_{k}") for k, gate in gates.items()])
    )
    return scored.withColumn("failure_tags", tags).select(
        case,
        *[F.round(k, 6).alias(k) for k in weights],
        "composite",
        (F.size("failure_tags") == 0).alias("passed"),
        "failure_tags",
    )


def run_summary(scored: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    passed = F.count_if("passed")
    return scored.agg(
        rows.alias("total_cases"),
        passed.alias("passed"),
        F.round(F.coalesce(F.try_divide(passed, rows), F.lit(0.0)), 6).alias("pass_rate"),
    )


def compare_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, delta) over the union of the metrics; an absent side counts as zero."""
    left = baseline.select("metric", F.col("value").alias("_base"))
    right = current.select("metric", F.col("value").alias("_now"))
    zero = F.lit(0.0)
    return left.join(right, "metric", "full_outer").select(
        F.concat("metric", F.lit("_delta")).alias("metric"),
        F.round(F.coalesce("_now", zero) - F.coalesce("_base", zero), 6).alias("delta"),
    )


def case_issues(cases: DataFrame, claimed: DataFrame, case: str = "case_id") -> DataFrame:
    """Problems of each case: absent fields, unknown attribution keys, no readable claim."""
    known = [c.lower() for c in V.CANONICAL_FEATURES]
    keys = F.map_keys("attributions")
    unknown = F.filter(keys, lambda k: ~F.lower(canonical_name(k)).isin(*known))
    stated = claimed.select(case).distinct().withColumn("_has", F.lit(True))
    joined = cases.join(stated, case, "left")
    has_text = F.coalesce(F.length(F.trim("explanation")), F.lit(0)) > 0
    issues = F.array_compact(
        F.array(
            F.when(F.col("explanation").isNull(), "missing_explanation"),
            F.when(F.col("attributions").isNull(), "missing_attributions"),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown_keys: "), F.array_join(unknown, ", "))),
            F.when(has_text & F.col("_has").isNull(), "no_claims"),
        )
    )
    return joined.select(case, issues.alias("issues"))
