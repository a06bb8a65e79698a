"""Matching records between tables: prioritised joins, scored best matches, change detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import first_per_key


def match_waterfall(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id, step): the match of the first key pair that has one, of several the smallest id.

    Each step joins only rows that have its key; a step's right side is cut to one row a key before."""
    found = []
    for step, (a, b) in enumerate(keys):
        own = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("_key")).agg(F.min(right_id).alias(right_id))
        found.append(left.where(F.col(a).isNotNull()).select(left_id, F.col(a).alias("_key")).join(own, "_key").select(left_id, right_id, F.lit(step).alias("step")))
    every = reduce(DataFrame.unionByName, found)
    return first_per_key(every, [left_id], ["step", right_id])


def best_match(pairs: DataFrame, left_id: str, right_id: str, score: Column, least: float) -> DataFrame:
    """The best scored partner of each left row at or over ``least``, of equal ones the smallest id."""
    scored = pairs.select(left_id, right_id, score.alias("score")).where(F.col("score") >= least)
    best = scored.groupBy(left_id).agg(F.max_by(F.struct(right_id, "score"), F.struct(F.col("score"), -F.col(right_id))).alias("best"))
    return best.select(left_id, f"best.{right_id}", "best.score")


def classify_changes(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, change): insert, delete, update or skip; nulls are equal to nulls."""
    marked_old = old.select(*key, F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    marked_new = new.select(*key, F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    joined = marked_old.join(marked_new, list(key), "full")
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "skip").otherwise("update")
    return joined.select(*key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` and those of ``old`` whose key is not in it."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)
