"""Date parsing and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date forms, ISO first, then day first, then month first.
DATE_PATTERNS = (
    "yyyy-M-d",
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ss",
    "yyyy/M/d",
    "yyyyMMdd",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "M/d/yyyy",
    "M-d-yyyy",
)

# Names of the calendar features.
CALENDAR_PARTS = ("day_of_week", "month", "quarter", "is_month_end")


def parse_mixed_date(text: Column | str) -> Column:
    """First pattern that fits, as a date; NULL when none does."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]).cast("date")


def calendar_part(date: Column, name: str) -> Column:
    """Calendar feature by name; Monday is weekday 0."""
    parts = {
        "day_of_week": lambda d: F.weekday(d),
        "month": lambda d: F.month(d),
        "quarter": lambda d: F.quarter(d),
        "is_month_end": lambda d: (d.cast("date") == F.last_day(d)).cast("int"),
    }
    if name not in parts:
        raise ValueError(f"unknown calendar part {name!r}, expected one of {', '.join(CALENDAR_PARTS)}")
    return parts[name](date)
