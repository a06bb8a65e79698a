"""Interval predicates and overrides on event-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps_inclusive(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start <= high) & (end >= low)


def overlaps_exclusive(start: Column, end: Column, low: Column, high: Column) -> Column:
    """An event that ends exactly where the range starts is outside."""
    return (start <= high) & (end > low)


def occurs(start: Column, end: Column, deadline: Column, low: Column, high: Column, inclusive: bool = True) -> Column:
    """The event overlaps the range, or its deadline lies in it."""
    inside = overlaps_inclusive(start, end, low, high) if inclusive else overlaps_exclusive(start, end, low, high)
    return F.coalesce(inside, F.lit(False)) | F.coalesce(deadline.between(low, high), F.lit(False))


def active_or_future(deadline: Column, end: Column, start: Column, now: Column) -> Column:
    return F.coalesce(deadline, end, start) >= now


def with_overrides(base: DataFrame, overrides: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``base`` with each column replaced by the override's value (column override_<name>) where it has one;
    ``overrides`` has at most one row a key."""
    joined = base.join(overrides, key, "left")
    return joined.select(*[c for c in base.columns if c not in columns], *(F.coalesce(f"override_{c}", c).alias(c) for c in columns), *[c for c in overrides.columns if c not in key and not c.startswith("override_")])


def day_series(low: Column, high: Column) -> Column:
    """All days from low to high, one row each when exploded."""
    return F.sequence(low, high, F.expr("interval 1 day"))
