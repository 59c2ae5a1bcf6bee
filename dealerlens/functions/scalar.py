"""Column functions: coercion, quantity kinds, medians of sorted arrays.

Unsupported values are NULL throughout, never 0 and never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(c: Column) -> Column:
    """A double with NaN and infinities as NULL, and one zero."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).when(d == 0, F.lit(0.0)).otherwise(d)


def coerce(c: Column, dtype: str) -> Column:
    """Any source column as a finite double; text that is no number is NULL."""
    if dtype == "string":
        return finite(F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double")))
    return finite(c)


def quantity_kind(c: Column, number: Column) -> Column:
    """Missing, Zero, Positive or Other."""
    return F.when(c.isNull(), "Missing").when(number == 0, "Zero").when(number > 0, "Positive").otherwise("Other")


def quantity_tag(c: Column, number: Column) -> Column:
    """Equal tags mean comparable quantities; only positive ones start with 'q='."""
    kind = quantity_kind(c, number)
    return F.when(kind == "Positive", F.concat(F.lit("q="), number.cast("string"))).when(kind == "Other", F.concat(F.lit("Other:"), c.cast("string"))).otherwise(kind)


def is_unknown_tag(tag: Column) -> Column:
    return (tag == "Missing") | tag.startswith("Other:")


def label(c: Column, placeholder: str | None = None) -> Column:
    clean = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return clean if placeholder is None else F.coalesce(clean, F.lit(placeholder))


def usable_key(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def sorted_median(a: Column) -> Column:
    """Median of a sorted array; NULL if empty."""
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def array_median(a: Column) -> Column:
    """Median of an array of non-null numbers; NULL if empty.  The sort must run once, so
    the sorted array passes through a one-element transform."""
    return F.get(F.transform(F.array(F.array_sort(a)), sorted_median), 0)


def minutes(ns: Column) -> Column:
    return ns / F.lit(60e9)


def day_of(ns: Column) -> Column:
    return F.date_from_unix_date(F.floor(ns / F.lit(86_400_000_000_000)).cast("int"))
