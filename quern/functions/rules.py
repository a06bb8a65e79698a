"""Rule tables as column expressions: ordered lists of (condition, value) folded into one CASE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule whose condition holds; a null condition does not."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def all_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in the order of the rules."""
    return F.filter(F.array(*(F.when(condition, F.lit(name)) for condition, name in rules)), lambda r: r.isNotNull())


def points(rules: Sequence[tuple[Column, float]]) -> Column:
    """The sum of the points of the rules that hold."""
    return sum((F.when(condition, value).otherwise(0) for condition, value in rules), F.lit(0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def any_of_groups(groups: Sequence[Sequence[Column]]) -> Column:
    """Of each group one condition must hold."""
    out = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for condition in group:
            one = one | F.coalesce(condition, F.lit(False))
        out = out & one
    return out
