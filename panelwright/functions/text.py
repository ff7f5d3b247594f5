"""Rendering: readable cells, prompt text, lineage keys, feature names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as V


def standardize_name(header: str, renamed: Mapping[str, str] = V.RENAMED_HEADERS) -> str:
    """Raw header to snake case ('M0_%Adherence' -> 'm0_pct_adherence')."""
    header = header.strip()
    if header in renamed:
        return renamed[header]
    name = header.replace("%", "pct_")
    name = re.sub(r"[?:'().]", "", name)
    name = re.sub(r"[/\-\s]+", "_", name)
    name = re.sub(r"_{2,}", "_", name).strip("_").lower()
    return name.replace("factor_s_for", "factors_for")


def standardize_columns(df):
    """All columns renamed; a name produced twice is an error the caller must resolve."""
    names = [standardize_name(c) for c in df.columns]
    repeated = sorted(n for n, k in Counter(names).items() if k > 1)
    if repeated:
        raise ValueError(f"columns collide after renaming: {repeated}")
    return df.toDF(*names)


def with_unit(c: Column, unit: str) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.1f {unit}", c.cast("double")))


def show_date(c: Column, pattern: str = "MM/dd/yyyy") -> Column:
    return F.date_format(c, pattern)


def lineage_key(*parts: Column) -> Column:
    """SHA-256 over the pipe-joined parts that determine a result."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def feature_base(name: Column) -> Column:
    """Base measure behind a per-step, aggregate, trend or latest feature name."""
    raw = F.regexp_extract(name, r"^M\d+_(.+)$", 1)
    engineered = F.regexp_extract(name, r"^(?:mean|std|min|max|trend|latest)_(.+)$", 1)
    return F.when(raw != "", raw).when(engineered != "", engineered).otherwise(name)


def feature_group(name: Column) -> Column:
    """Reporting group of a model feature name; names without one are marked."""
    prefix = F.lit(None).cast("string")
    for start, group in reversed(list(V.ONE_HOT_GROUPS.items())):
        prefix = F.when(name.startswith(start), group).otherwise(prefix)
    base = feature_base(name)
    lookup = F.create_map(*[F.lit(x) for pair in V.FEATURE_GROUPS.items() for x in pair])
    marker = F.when(base == name, F.concat(F.lit("STATIC_"), name)).otherwise(
        F.concat(F.lit("UNMAPPED_"), base)
    )
    return F.coalesce(
        prefix,
        F.when(base.startswith("is_missing_"), V.MISSING_GROUP),
        F.try_element_at(lookup, base),
        marker,
    )


def feature_family(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^M\d+_"), "raw_step")
        .when(name.rlike(r"^(mean|std|min|max)_"), "aggregate")
        .when(name.startswith("trend_"), "trend")
        .when(name.startswith("latest_"), "latest")
        .when(name.startswith("months_"), "availability")
        .otherwise("static")
    )


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def profile_lines(fields: Sequence[tuple[str, Column]]) -> Column:
    """One '- label: value' line per present field; concat of a null drops the line."""
    return F.concat_ws("\n", *[_line(label, value) for label, value in fields])


def contribution_lines(contributions: Column, values: Column | None = None, k: int = 5) -> Column:
    """Lines for the first ``k`` of an array<struct<feature, delta>>, signed in percent."""

    def render(item: Column) -> Column:
        feature, delta = item["feature"], item["delta"]
        note = F.lit("")
        if values is not None:
            known = F.try_element_at(values, feature)
            note = F.coalesce(
                F.concat(F.lit(" (patient value: "), known, F.lit(")")), F.lit("")
            )
        way = F.when(delta > 0, "increases").otherwise("decreases")
        return F.concat(
            F.lit("- "), feature, note, F.lit(": "),
            F.format_string("%+.1f", delta * 100), F.lit("% impact ("), way,
            F.lit(" failure risk)"),
        )

    return F.array_join(F.transform(F.slice(contributions, 1, k), render), "\n")


BLIND_TEXT = (
    "Contributing factors are withheld. Name the three to five factors you believe "
    "drove this prediction and reason from them."
)


def prompt_text(
    fields: Sequence[tuple[str, Column]],
    probability: Column,
    contributions: Column,
    blind: Column | bool = False,
    values: Column | None = None,
    blind_text: str = BLIND_TEXT,
) -> Column:
    """Prompt column: profile, predicted probability and, when sighted, top factors."""
    blind = blind if isinstance(blind, Column) else F.lit(blind)
    withheld = blind | contributions.isNull() | (F.size(contributions) == 0)
    factors = F.when(withheld, blind_text).otherwise(contribution_lines(contributions, values))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Patient profile:\n"), profile_lines(fields)),
        F.concat(
            F.lit("Predicted failure probability: "),
            F.format_string("%.0f%%", F.bround(probability * 100, 0)),
        ),
        F.concat(F.lit("Top contributing factors:\n"), factors),
    )
