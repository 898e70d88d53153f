"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_contains_ci(values: Column, wanted: str | Column) -> Column:
    """True if some whole element equals ``wanted`` whatever its case; nothing is trimmed.
    False for a null array and for arrays without it, null elements included."""
    low = F.lit(wanted.lower()) if isinstance(wanted, str) else F.lower(wanted)
    return F.coalesce(F.exists(values, lambda x: F.coalesce(F.lower(x) == low, F.lit(False))), F.lit(False))


def array_contains(values: Column, wanted) -> Column:
    """True if some element equals ``wanted`` exactly; false otherwise, also for null."""
    return F.coalesce(F.array_contains(values, wanted), F.lit(False))


def parse_bool(text: Column) -> Column:
    """True for "true" in any case; false for all else, null included."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def parse_list(text: Column) -> Column:
    """The elements of a comma list, outer double quotes taken off, nothing trimmed. Empty
    or null text gives one empty element."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), '^"+|"+$', ""), ",", -1)


def parse_int(text: Column) -> Column:
    """A decimal integer with an optional sign, or null: no blanks, no fractions."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_float(text: Column) -> Column:
    """A double, or null; blanks around the number aren't taken."""
    return F.when(~text.rlike(r"^\s|\s$"), text.try_cast("double"))


def extract_decade(text: Column) -> Column:
    """The decade of a date such as "Jan 2, 2006"; 0 for what isn't such a date."""
    year = F.year(F.try_to_date(text, "MMM d, yyyy"))
    return F.coalesce((F.floor(year / 10) * 10).cast("int"), F.lit(0))


def quantile_index(n: Column, percentile: float | Column) -> Column:
    """The zero-based place of a percentile among n ordered values, cut off to an integer."""
    share = percentile.cast("double") / 100.0 if isinstance(percentile, Column) else F.lit(percentile / 100.0)
    return F.floor(n.cast("double") * share).cast("long")


def polarity(score: Column, positive: bool) -> Column:
    """Scores above zero, or below zero; zero and null are neither."""
    return F.coalesce(score > 0 if positive else score < 0, F.lit(False))
