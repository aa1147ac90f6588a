"""Dates, durations and temporal clauses as Column expressions; `as_of` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Days of a unit, date formats of spreadsheets, and the ladder of temporal clauses.
UNIT_DAYS = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yyyy", "yyyy/MM/dd")
CLAUSES = [
    ("before", r"\b(prior to|before|in advance of)\b"), ("after", r"\b(after|following|upon completion|upon receipt|upon approval)\b"), ("deadline", r"\b(within|no later than|not later than)\b"),
    ("minimum-lead-time", r"\bat least\b"), ("blocking-until", r"\buntil\b"), ("during", r"\bduring\b"), ("trigger", r"\bwhen\b"),
]
DURATION = r"\b(\d+(?:\.\d+)?)\s+(?:(calendar|business|working)\s+)?(minute|hour|day|week|month|year)s?\b"
ABSOLUTE = r"\b(?:(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},\s*\d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\b"


def parsed_date(c: Column | str) -> Column:
    """A date from any of the known formats, else null."""
    s = T.squeezed(c)
    patterns = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{4}/\d{2}/\d{2}$"]
    return F.coalesce(*(F.when(s.rlike(p), F.try_to_timestamp(F.initcap(s), F.lit(f)).cast("date")) for p, f in zip(patterns, FORMATS, strict=True)))


def duration_days(amount: Column, unit: Column, modifier: Column) -> Column:
    """Calendar days of a duration; five business or working days are a week."""
    m = F.create_map(*(F.lit(x) for kv in UNIT_DAYS.items() for x in kv))
    days = amount * F.coalesce(F.try_element_at(m, F.regexp_replace(F.lower(unit), "s$", "")), F.lit(0.0))
    return F.when(F.lower(modifier).isin("business", "working"), F.floor(days / 5) * 7 + days % 5).otherwise(days)


def durations(c: Column | str) -> Column:
    """array<struct<amount, unit, modifier, days>> of a text, in order."""
    s = F.lower(T.folded(c))
    get = lambda i: F.regexp_extract_all(s, F.lit(DURATION), F.lit(i))
    z = F.arrays_zip(get(1).alias("a"), get(2).alias("m"), get(3).alias("u"))
    return F.transform(z, lambda x: F.struct(x["a"].cast("double").alias("amount"), x["u"].alias("unit"), x["m"].alias("modifier"), duration_days(x["a"].cast("double"), x["u"], x["m"]).alias("days")))


def absolute_dates(c: Column | str) -> Column:
    return F.regexp_extract_all(T.folded(c), F.lit(f"(?i)({ABSOLUTE})"))


def clause_type(c: Column | str) -> Column:
    return T.ladder(c, CLAUSES, "temporal")


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b, rounded."""
    return T.rounded((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("long")


def due_bucket(due: Column, as_of: Column) -> Column:
    d = F.datediff(due, as_of)
    return F.when(d < 0, "overdue").when(d <= 7, "due-soon").when(d <= 30, "upcoming").when(d.isNotNull(), "scheduled").otherwise("undated")


def due_risk(bucket: Column, priority: Column, blocker: Column, unresolved: Column, complete: Column) -> Column:
    """Points: 60, 35 or 15 by bucket, 25 or 15 by priority, 20 for a blocker, 10 if unresolved; nothing if complete."""
    s = F.when(bucket == "overdue", 60).when(bucket == "due-soon", 35).when(bucket == "upcoming", 15).otherwise(0)
    s = s + F.when(priority >= 70, 25).when(priority >= 50, 15).otherwise(0) + F.when(blocker, 20).otherwise(0) + F.when(unresolved, 10).otherwise(0)
    return F.when(complete, 0).otherwise(s)


def stale(updated: Column, as_of: Column, hours: int = 24) -> Column:
    return updated.isNull() | (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(updated) > hours * 3600)
