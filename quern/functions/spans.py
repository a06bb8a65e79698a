"""Dates and times in lines of text: all spans of a line with their places, and what they stand for.

A span is one date or two with a sign between them. The scanner reads a line from left to right and takes the longer
form where both fit, so spans never overlap. Its patterns are put together from the parts of a date: each number is
followed by a sign of its own (dots, strokes, or the word for year, month or day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words for year, month, day, from and until.
YEAR, MONTH, DAY, FROM = "년", "월", "일", "부터"


def number(digits: str, sign: str, joints: bool = True) -> str:
    """A number and its sign: the word, or one of the joints between the numbers of a date."""
    return rf"({digits})\s*(?:[.\-/]|{sign})" if joints else rf"({digits})\s*{sign}"


_YEAR, _MONTH, _DAY = rf"(?:{number('[0-9]{4}', YEAR)}\s*)?", number("[0-9]{1,2}", MONTH), rf"([0-9]{{1,2}})(?:\s*{DAY})?"
_BETWEEN = rf"\s*(?:~|-|{FROM})\s*"
_ALONE_BEFORE, _ALONE_AFTER = r"(?<![0-9:])", r"(?![0-9:])"
#: Groups: year, month, day of the first date, then of the second.
RANGE = rf"{_ALONE_BEFORE}{_YEAR}{_MONTH}\s*{_DAY}{_BETWEEN}{_YEAR}(?:{_MONTH}\s*)?{_DAY}{_ALONE_AFTER}"
SINGLE = rf"{_ALONE_BEFORE}{_YEAR}{_MONTH}\s*{_DAY}{_ALONE_AFTER}"
SPAN = f"(?:{RANGE}|{SINGLE})"
_HOUR = r"([0-9]{1,2})(?::([0-9]{2}))?"
#: Groups: hour and minute of the start, then of the end; and of one time.
TIME_RANGE = rf"(?<![0-9]){_HOUR}\s*(?:~|-|{FROM})\s*{_HOUR}(?![0-9])"
TIME = r"(?<![0-9])([0-9]{1,2}):([0-9]{2})(?![0-9])"
DEADLINE_WORDS = ("마감", "까지", "제출", "deadline", "due")


def with_spans(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with spans, array<struct<start:int, length:int, numbers:array<string>>>: a line's spans in order; start counts
    characters from 0. A null line has none."""
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    place = lambda i: total(F.slice("_gaps", F.lit(1), i + 1)) + total(F.transform(F.slice("_found", F.lit(1), i), lambda t: F.length(t)))
    one = lambda t, i: F.struct(place(i).alias("start"), F.length(t).alias("length"), F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1)).alias("numbers"))
    read = lines.withColumn("_found", F.regexp_extract_all(line, F.lit(f"({SPAN})"), F.lit(1))).withColumn("_gaps", F.transform(F.split(line, SPAN), lambda g: F.length(g)))
    return read.withColumn("spans", F.transform("_found", one)).drop("_found", "_gaps")


def without_spans(line: Column) -> Column:
    return F.regexp_replace(line, SPAN, " ")


def real_day(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null if the calendar does not have it."""
    opening = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.day(F.last_day(opening))), F.date_add(opening, day - 1))


def with_days(spans: DataFrame, year: int) -> DataFrame:
    """``spans`` with first and last day of the span of column numbers, those of no real day left out; a date without a year is
    of ``year``, the second one of the first one's year and month unless it names its own. A span is told by its numbers: one
    of four digits is a year."""
    n = F.col("numbers")
    at = lambda i: F.try_element_at(n, i).cast("int")
    named = (F.length(n[0]) == 4).cast("int")
    split = spans.withColumn("_named", named)
    own = F.col("_named")
    again = (F.length(F.try_element_at(n, own + 3)) == 4).cast("int")
    split = split.withColumn("_again", F.coalesce(again, F.lit(0))).withColumn("_left", F.size(n) - own - 2 - F.col("_again"))
    y, m, d = F.when(own == 1, at(F.lit(1))).otherwise(year), at(own + 1), at(own + 2)
    y2, m2, d2 = F.when(F.col("_again") == 1, at(own + 3)).otherwise(y), F.when(F.col("_left") == 2, at(F.size(n) - 1)).otherwise(m), at(F.size(n))
    both = split.withColumn("first", real_day(y, m, d)).withColumn("last", F.when(F.col("_left") == 0, F.col("first")).otherwise(real_day(y2, m2, d2)))
    return both.where("first IS NOT NULL AND last IS NOT NULL").drop("_named", "_again", "_left")


def with_moments(rows: DataFrame, line: str, deadline_words: tuple[str, ...] = DEADLINE_WORDS) -> DataFrame:
    """``rows`` (with first and last day) with start_at, end_at (timestamps without a zone) and all_day: a line's range of times if it
    has one, else its one time, for a minute if a word tells of a deadline and an hour if none does, else the whole days.
    Times that no clock shows count as none. The line should have its dates taken out."""
    # each pattern is looked for once; what it found is taken apart by its signs
    clock = lambda text: F.transform(F.split(F.trim(text), ":"), lambda n: F.nullif(F.trim(n), F.lit("")).cast("int"))
    read = rows.withColumn("_range", F.regexp_extract(line, TIME_RANGE, 0)).withColumn("_clock", F.regexp_extract(line, TIME, 0))
    sides = F.split(F.nullif("_range", F.lit("")), f"~|-|{FROM}")
    read = read.withColumn("_sides", F.transform(sides, clock)).withColumn("_one", clock(F.nullif("_clock", F.lit(""))))

    def at(day: str, hour: Column, minute: Column) -> Column:
        minutes = F.coalesce(minute, F.lit(0))
        return F.when((hour < 24) & (minutes < 60), F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minutes))

    part = lambda side, n: F.try_element_at(F.try_element_at("_sides", F.lit(side)), F.lit(n))
    hour, minute = F.try_element_at("_one", F.lit(1)), F.try_element_at("_one", F.lit(2))
    read = read.withColumn("_start", at("first", part(1, 1), part(1, 2))).withColumn("_end", at("last", part(2, 1), part(2, 2))).withColumn("_time", at("first", hour, minute))
    ranged = F.col("_start").isNotNull() & F.col("_end").isNotNull()
    due = F.lower(line).rlike("|".join(deadline_words))
    length = F.when(due, F.make_dt_interval(mins=F.lit(1))).otherwise(F.make_dt_interval(hours=F.lit(1)))
    start = F.when(ranged, F.col("_start")).when(F.col("_time").isNotNull(), F.col("_time")).otherwise(F.col("first").cast("timestamp_ntz"))
    end = F.when(ranged, F.col("_end")).when(F.col("_time").isNotNull(), F.col("_time") + length).otherwise(F.date_add("last", 1).cast("timestamp_ntz"))
    return read.withColumn("start_at", start).withColumn("end_at", end).withColumn("all_day", ~ranged & F.col("_time").isNull()).drop("_range", "_clock", "_sides", "_one", "_start", "_end", "_time")
