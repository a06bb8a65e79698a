"""Row selection by window rank: per key, per group, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], rank: int = 1) -> DataFrame:
    """The row of the given rank for each key; ``order`` must end in a unique column. Keys with fewer rows
    have none."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rank") == rank).drop("_rank")


def first_n_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """Up to ``n`` rows for each key."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def duplicate_groups(df: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """Keys with more than one row: size, the member kept (the smallest) and the number to go."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(member).alias("kept")).where("n_rows > 1").withColumn("n_removed", F.col("n_rows") - 1)


def islands(df: DataFrame, key: Sequence[str], day: str) -> DataFrame:
    """``df`` with island (the first day of its run of consecutive days) and position within it; one row a
    day for each key."""
    own = W.partitionBy(*key).orderBy(day)
    marked = df.withColumn("_anchor", F.date_sub(day, F.row_number().over(own).cast("int")))
    run = W.partitionBy(*key, "_anchor")
    return marked.withColumn("island", F.min(day).over(run)).withColumn("run_length", F.count("*").over(run)).withColumn("run_position", F.row_number().over(run.orderBy(day))).drop("_anchor")


def interleave(df: DataFrame, bucket: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """Round robin over buckets up to ``limit`` rows: the first of each bucket, then the second, …

    Only rows that can be among the first ``limit`` are ordered at the end, by a top-k, not a full sort."""
    turn = df.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    return turn.where(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int, most: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, at most ``most``."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def spread_rank(df: DataFrame, group: str, key: str, unique: str, digits: int = 3) -> DataFrame:
    """``df`` with rank and group_size: its place within the group in the order of (key, unique), where the
    key is hexadecimal text that spreads evenly, such as a hash.

    No task sorts a whole group: rows are ranked among those of equal leading digits, and the counts of
    the digits before, at most 16 ** digits a group, are added."""
    marked = df.withColumn("_digits", F.substring(key, 1, digits))
    counted = marked.groupBy(F.col(group).alias("_group"), F.col("_digits").alias("_own")).agg(F.count("*").alias("_n"))
    every = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(every.orderBy("_own").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("_group", "_own", before.alias("_before"), F.sum("_n").over(every).alias("group_size"))
    joined = marked.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_digits") == F.col("_own")))
    place = F.row_number().over(W.partitionBy(group, "_digits").orderBy(key, unique))
    return joined.withColumn("rank", F.col("_before") + place).drop("_digits", "_group", "_own", "_before")
