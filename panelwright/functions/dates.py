"""Date parsing, repair and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as V


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_mixed_date(
    c: Column,
    latest_year: int = 2026,
    valid_years: tuple[int, int] = (1900, 2100),
) -> Column:
    """Month-first dates in mixed notation; day-first only where month-first cannot be.

    Trailing junk is dropped, a four-digit year past ``latest_year`` becomes 19xx, and a
    two-digit year lands within fifty years of ``latest_year``.
    """
    text = F.trim(F.regexp_replace(F.trim(c), r"[^0-9/\-]+$", ""))
    named = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"
    iso = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"

    is_iso = text.rlike(iso)
    raw_year = F.when(is_iso, _number(text, iso, 1)).otherwise(_number(text, named, 3))
    short = ~is_iso & F.regexp_extract(text, named, 3).rlike(r"^\d{2}$")
    century = latest_year - latest_year % 100
    near = raw_year + century
    near = F.when(near >= latest_year + 50, near - 100).otherwise(near)
    slashed = text.rlike(r"/\d{4}$")
    year = (
        F.when(short, near)
        .when(slashed & (raw_year > latest_year), 1900 + raw_year % 100)
        .otherwise(raw_year)
    )
    first = F.when(is_iso, _number(text, iso, 2)).otherwise(_number(text, named, 1))
    second = F.when(is_iso, _number(text, iso, 3)).otherwise(_number(text, named, 2))
    swap = ~is_iso & (first > 12) & (second <= 12)
    month = F.when(swap, second).otherwise(first)
    day = F.when(swap, first).otherwise(second)
    zero = F.lit(0)
    made = F.try_make_timestamp(year, month, day, zero, zero, zero).cast("date")
    return F.when((text.rlike(named) | is_iso) & year.between(*valid_years), made)


def _shift_years(c: Column, years: int) -> Column:
    return F.add_months(c, 12 * years)


def fix_birth_year(born: Column, data_year: Column | int = 2025) -> Column:
    """Undo a wrong century: births after the data year, or before 1920 at a modern age."""
    data_year = data_year if isinstance(data_year, Column) else F.lit(data_year)
    born = F.when(F.year(born) > data_year, _shift_years(born, -100)).otherwise(born)
    later = _shift_years(born, 100)
    mid_year = F.make_date(data_year, F.lit(6), F.lit(1))
    age = F.datediff(mid_year, later) / 365.25
    return F.when((F.year(born) < 1920) & age.between(0, 110), later).otherwise(born)


def fix_future_year(c: Column, data_year: Column | int = 2025, slack: int = 2) -> Column:
    data_year = data_year if isinstance(data_year, Column) else F.lit(data_year)
    return F.when(F.year(c) > data_year + slack, _shift_years(c, -10)).otherwise(c)


def enforce_order(start: Column, not_before: Column) -> Column:
    """``start`` moved up to ``not_before`` where it precedes it."""
    return F.when(start < not_before, not_before).otherwise(start)


def interval_days(earlier: Column, later: Column, low: int, high: int) -> Column:
    days = F.datediff(later, earlier)
    return F.when(days.between(low, high), days)


def season(month: Column, calendar: dict[int, str] = V.SEASON_LOCAL) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in calendar.items() for x in pair])
    return F.try_element_at(lookup, month.cast("int"))


def date_parts(c: Column, prefix: str, calendar: dict[int, str] = V.SEASON_LOCAL) -> list[Column]:
    return [
        F.month(c).alias(f"{prefix}_month"),
        F.quarter(c).alias(f"{prefix}_quarter"),
        F.dayofyear(c).alias(f"{prefix}_day_of_year"),
        season(F.month(c), calendar).alias(f"{prefix}_season"),
    ]


def age_in_year(born: Column, year: Column, low: int = 0, high: int = 110) -> Column:
    age = year - F.year(born)
    return F.when(age.between(low, high), age)


def epoch_day(c: Column) -> Column:
    return F.unix_date(c.cast("date")).cast("double")
