"""Category harmonisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as V
from panelwright.functions.parsing import clean_key


def map_category(c: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Trimmed, case-blind lookup; text outside the map becomes ``default``."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(lookup, clean_key(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def keyword_bucket(
    c: Column, rules: Sequence[tuple[str, str]], other: str | None, missing: str | None = None
) -> Column:
    """First rule whose pattern occurs decides; null text gives ``missing``."""
    text = clean_key(c)
    out = F.when(c.isNull(), missing)
    for pattern, label in rules:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(other)


def chest_film(c: Column) -> Column:
    """'abnormal' is not 'normal': whole words are compared."""
    return keyword_bucket(
        c, [(r"\bnormal\b", "Normal"), (r"ptb|tb|parenchymal", "Suggestive of PTB")], "Other"
    )


def rapid_test(c: Column) -> Column:
    """Negative wordings first, since 'not detected' also contains 'detected'."""
    return keyword_bucket(
        c,
        [("|".join(V.RDT_NEGATIVE_WORDS), "Not_Detected"),
         ("|".join(V.RDT_POSITIVE_WORDS), "Detected")],
        "Not_Done",
        missing="Not_Done",
    )


def comorbidity_class(c: Column) -> Column:
    return keyword_bucket(
        c,
        [(r"^(no known|none|)$", "None"),
         (r"diabetes|dm", "Diabetes"),
         (r"hypertension|htn|elevated bp", "Hypertension"),
         (r"cancer", "Cancer"),
         (r"ckd|kidney", "Kidney Disease"),
         (r"cardiovascular", "Cardiovascular")],
        "Other",
    )


def prior_history(c: Column) -> Column:
    return keyword_bucket(c, [(r"^(no|none|n/a|)$", "No")], "Yes")


def dosing_support(c: Column) -> Column:
    return keyword_bucket(c, [(r"^yes$", "Yes")], "No")


def normalize_terms(
    c: Column,
    terms: Mapping[str, str] = V.COMORBIDITY_TERMS,
    none_words: Sequence[str] = V.COMORBIDITY_NONE,
    none_label: str = V.COMORBIDITY_NONE_LABEL,
) -> Column:
    """Multi-answer text as a canonical ', ' list in answer order, without repeats.

    Longer dictionary keys are tried first so that a specific term beats one it contains.
    Answers outside the dictionary are kept in title case.
    """
    keys = sorted(terms, key=lambda k: (-len(k), k))
    skipped = [w for w in none_words if w != "n/a"]

    def canonical(part: Column) -> Column:
        text = clean_key(part)
        out = F.when(text.isin("", *skipped), F.lit(None).cast("string"))
        for key in keys:
            out = out.when(text.contains(key), terms[key])
        return out.otherwise(F.initcap(text))

    raw = F.trim(c)
    parts = F.array_compact(F.transform(F.split(raw, r"[,;.]+"), canonical))
    joined = F.array_join(F.array_distinct(parts), ", ")
    return F.when(F.lower(raw).isin(*none_words), none_label).when(joined != "", joined)


def null_misplaced(c: Column, pattern: str = V.MISPLACED_FILM_PATTERN) -> Column:
    return F.when(~F.lower(c).rlike(pattern), c)


def microscopy_grade(c: Column) -> Column:
    return map_category(c, V.MICROSCOPY, default="Unknown")


def whitelist(c: Column, allowed: Sequence[str]) -> Column:
    return F.when(c.isin(*allowed), c)


def nationality(c: Column, home: str = "Filipino") -> Column:
    text = clean_key(c)
    return F.when(text == home.lower(), home).when(
        ~text.isin("n/a", "nan", ""), F.initcap(text)
    )


def outcome_category(c: Column) -> Column:
    text = F.upper(F.trim(c))
    return (
        F.when(text.isin("CURED", "TREATMENT COMPLETED"), "Success")
        .when(text == "DIED", "Died")
        .when(text == "LOST TO FF-UP", "Lost to Follow-up")
        .otherwise("Other")
    )


def success_label(
    c: Column, success: Sequence[str] = V.SUCCESS_OUTCOMES, failure: Sequence[str] | None = None
) -> Column:
    """1 / 0 label. Without ``failure`` every other observed outcome is a failure;
    with it, outcomes in neither list are unlabelled (null)."""
    label = F.when(c.isin(*success), 1)
    if failure is None:
        return label.when(c.isNotNull(), 0)
    return label.when(c.isin(*failure), 0)
