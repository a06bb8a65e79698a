"""Planned events that a reading of notices should not have made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.rules import all_reasons


@dataclass(frozen=True)
class Wrong:
    """What tells of them; all titles, words and days are the caller's. ``unless`` exempts titles with one of its words from
    ``suspect``; ``only`` allows one title on a day; ``never`` has a word that is wrong on a day; ``repeated`` a title and days on
    which repairs made it, too; ``exactly`` a title that is wrong on a day."""

    titles: Sequence[str] = ()
    words: Sequence[str] = ()
    endings: Sequence[str] = ()
    suspect: str | None = None
    unless: Sequence[str] = ()
    phrases: Sequence[str] = ()
    days: Sequence[date] = ()
    only: Sequence[tuple[date, str]] = ()
    never: Sequence[tuple[date, str]] = ()
    repeated: tuple[str, Sequence[date]] | None = None
    exactly: Sequence[tuple[date, str]] = ()


def wrong_reasons(title: Column, day: Column, read: Column, repaired: Column, wrong: Wrong) -> Column:
    """The reasons, in order, for which an event is wrong. Only events read from a notice are, and for ``repeated`` those of a
    repair; one pass over the rows, each once however many reasons it has."""

    def some(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for condition in conditions:
            out = out | condition
        return out

    names = lambda words: some([F.contains(title, F.lit(w)) for w in words])
    on = lambda d: day == F.lit(d)
    rules = [
        (read & title.isin(*wrong.titles), "title"),
        (read & names(wrong.words), "word"),
        (read & some([title.endswith(e) for e in wrong.endings]), "ending"),
        (read & (F.contains(title, F.lit(wrong.suspect)) & ~names(wrong.unless) if wrong.suspect else F.lit(False)), "suspect"),
        (read & names(wrong.phrases), "phrase"),
        (read & day.isin(*wrong.days), "day"),
        (read & some([on(d) & (title != t) for d, t in wrong.only]), "not the day's"),
        (read & some([on(d) & F.contains(title, F.lit(w)) for d, w in wrong.never]), "word on a day"),
        ((read | repaired) & ((title == wrong.repeated[0]) & day.isin(*wrong.repeated[1]) if wrong.repeated else F.lit(False)), "repeated"),
        (read & some([on(d) & (title == t) for d, t in wrong.exactly]), "title on a day"),
    ]
    return all_reasons(rules)
