"""Dates in the spellings that records carry, ages, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date spellings that are tried in order; the first that fits wins.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}", r"^(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}", r"^(\d{4}/\d{2}/\d{2})", "yyyy/MM/dd"),
    (r"^\d{8}$", r"^(\d{8})$", "yyyyMMdd"),
    (r"^\d{2}\.\d{2}\.\d{4}", r"^(\d{2}\.\d{2}\.\d{4})", "dd.MM.yyyy"),
)


#: Fixed value: days for which a source counts as fresh.
FRESH = 90


def lenient_date(text: Column) -> Column:
    """DATE of a text in one of FORMATS, time of day ignored; null for anything else."""
    t = F.trim(text)
    out = None
    for test, take, form in FORMATS:
        value = F.when(t.rlike(test), F.try_to_date(F.regexp_extract(t, take, 1), form))
        out = value if out is None else F.coalesce(out, value)
    return out


def date_in_id(doc: Column) -> Column:
    """The date at the end of a document id, before an optional hash."""
    return F.try_to_date(F.nullif(F.regexp_extract(doc, r"-(\d{4}-\d{2}-\d{2})(?:-[0-9a-f]{8})?$", 1), F.lit("")), "yyyy-MM-dd")


def age_days(date: Column, as_of: str) -> Column:
    """Days from date to as_of, 0 for dates after it, null for a null date."""
    return F.when(date.isNotNull(), F.greatest(F.datediff(F.lit(as_of).cast("date"), date), F.lit(0)))


def source_type(text: Column) -> Column:
    """A source type in lower case with dashes; null for stand-ins of a missing value."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-")
    return F.when(~t.isin("", "-", "n/a", "na", "none", "null", "unknown", "?", "nan"), t)


def trust_tier(kind: Column, age: Column) -> Column:
    """1 for official sources of at most 90 days, 2 up to 180 days (or extracted ones), 3 for all else."""
    return F.when((kind == "official-doc") & (age <= 90), 1).when(kind.isin("official-doc", "extracted") & (age <= 180), 2).otherwise(3)


def source_priority(kind: Column, age: Column) -> Column:
    """P0 to P3 by type and age: official P0 while fresh, then P1; uploads P1; community P2 while fresh, then P3; all else P3. An unknown age counts as 999 days."""
    days = F.coalesce(age, F.lit(999))
    return (
        F.when((kind == "official-doc") & (days <= FRESH), "P0")
        .when(kind.isin("official-doc", "user-upload"), "P1")
        .when((kind == "community") & (days <= FRESH), "P2")
        .otherwise("P3")
    )


def priority_number(priority: Column) -> Column:
    return F.when(priority.rlike(r"^P\d+$"), F.substring(priority, 2, 9).cast("int")).otherwise(99)


def is_due(last: Column, as_of: str, hours: int) -> Column:
    """Whether more than `hours` have passed since a date or time; a null one is due."""
    return F.coalesce(F.timestamp_diff("SECOND", last.cast("timestamp"), F.lit(as_of).cast("timestamp")) > hours * 3600, F.lit(True))
