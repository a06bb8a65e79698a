"""Partitions of a bounded number of rows, results that are computed once, and rules that run once for equal rows.

Adaptive execution puts shuffled partitions together by their compressed bytes, so that rows that compress well come in tasks
of millions, and what a task sorts grows with the table. Partitions of a given number stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition, about.
ROWS = 500_000


def dealt(df: DataFrame, n_rows: int, *key: str, rows: int = ROWS) -> DataFrame:
    """``df``, of some ``n_rows``, dealt by key into partitions of about ``rows``."""
    return df.repartition(max(1, -(-n_rows // rows)), *key)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once: in the checkpoint folder if there is one, else on the executors' disks. For what is read several
    times and costs more than its storage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir() and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)


def once_each(df: DataFrame, read: Callable[[DataFrame], DataFrame], *key: str) -> DataFrame:
    """``df`` with the columns that ``read`` adds to a frame of its distinct keys, of which each is read once; nulls are equal."""
    # the work is in rows, not in bytes, by which small partitions would be put together
    own = df.select(*key).distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    found = read(own).withColumnsRenamed({k: f"_own_{k}" for k in key})
    return df.join(found, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in key]).drop(*(f"_own_{k}" for k in key))
