"""Text to number parsers. Null in, null out; unreadable text becomes null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as V

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


def clean_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def to_number(c: Column) -> Column:
    """Number or null. Words such as NaN and infinity are not numbers here."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_measure(c: Column, unit: str) -> Column:
    """'45kg', '56.5 kg' and the plural '45kgs' all read as 45 / 56.5."""
    return to_number(F.regexp_replace(clean_key(c), f"{unit}s?", ""))


def split_ratio(c: Column) -> tuple[Column, Column]:
    """'120/80' as two doubles; both null unless the text starts with a ratio."""
    pattern = r"^(\d+)\s*/\s*(\d+)"
    text = F.trim(c)
    return tuple(
        F.regexp_extract(text, pattern, group).try_cast("double") for group in (1, 2)
    )


def parse_saturation(c: Column, low: float = 70.0, high: float = 100.0) -> Column:
    """Percent on a 0-100 scale; values up to 2 are fractions; implausible is null."""
    text = F.trim(c)
    v = to_number(F.regexp_replace(text, r"[%\s]+$", ""))
    v = F.when(v <= 2.0, v * 100.0).otherwise(v)
    readable = ~F.lower(text).isin(*V.SATURATION_SENTINELS)
    return F.when(readable & v.between(low, high), F.bround(v, 2))


def parse_proportion(c: Column, rescale: bool = True) -> Column:
    """'95.5%' and '0.95' as a share; ``rescale`` divides values above 1 by 100."""
    v = to_number(F.replace(F.trim(c), F.lit("%"), F.lit("")))
    return F.when(v > 1.0, v / 100.0).otherwise(v) if rescale else v


def binary_result(c: Column, negatives: Sequence[str], unknown: str = "positive") -> Column:
    """0 for a listed negative, null for blank, 1 for any other text.

    ``unknown='null'`` keeps 1 for text that names a positive finding only.
    """
    text = clean_key(c)
    result = F.when(text.isin(*negatives), 0.0).when(text.isin("", "nan"), None)
    if unknown == "null":
        positive = text.rlike(r"positive|detected|trace|scanty|^[1-4]\+$|^\+$|afb|^p$")
        return result.when(positive & ~text.rlike(r"\bnot\b|\bno\b"), 1.0)
    return result.when(text.isNotNull(), 1.0)


def smear_result(c: Column, unknown: str = "positive") -> Column:
    return binary_result(c, V.SMEAR_NEGATIVES, unknown)


def xpert_result(c: Column, unknown: str = "positive") -> Column:
    return binary_result(c, V.XPERT_NEGATIVES, unknown)


def parse_lenient(c: Column) -> Column:
    """Any per-step cell as a number: unit stripped, else a finding word, else null."""
    text = clean_key(c)
    number = to_number(F.regexp_replace(text, r"kgs?|cms?|%", ""))
    word = F.when(text.isin(*V.LENIENT_NEGATIVES), 0.0).when(
        text.isin(*V.LENIENT_POSITIVES), 1.0
    )
    return F.coalesce(number, word)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
