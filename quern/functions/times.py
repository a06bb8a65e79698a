"""Calendar expressions: Monday weeks, months, weeks of a month, guarded parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def month_start(day: Column, offset: int = 0) -> Column:
    return F.add_months(F.trunc(day, "MM"), offset)


def month_end(day: Column, offset: int = 0) -> Column:
    return F.last_day(month_start(day, offset))


def week_of_month(day: Column) -> Column:
    """Weeks count from the month's first Monday; days before it have none."""
    monday = F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "MON")
    return F.when(day >= monday, F.floor(F.datediff(day, monday) / 7) + 1).cast("int")


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def nearest_weekday(day: Column, wanted: int) -> Column:
    """The day of the same Monday week that falls on ``wanted``."""
    return F.date_add(day, F.lit(wanted) - F.weekday(day))


def days_until(day: Column, today: Column) -> Column:
    return F.greatest(F.datediff(day, today), F.lit(0))


def day_badge(day: Column, today: Column) -> Column:
    left = F.datediff(day, today)
    return F.when(left == 0, "D-Day").when(left > 0, F.concat(F.lit("D-"), left.cast("string"))).otherwise(F.concat(F.lit("D+"), (-left).cast("string")))


def first_date(value: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd")) -> Column:
    """The first format that parses, else null."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in formats))
