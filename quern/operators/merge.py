"""Merging a load into a stored table of Parquet files, of which only the parts that change are written again.

The table lies in folders by bucket of its key's hash. A merge reads the buckets that the load's keys fall into, and of
those writes only the ones in which a row is new or differs. New contents are written beside the table first and then
put in place bucket by bucket; a merge that is cut off is run again, and finds what is in place already as unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def canonical_json(value: Column) -> Column:
    """A JSON text with sorted keys and no white space; one that is no JSON, as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def before_mark(text: Column, mark: str) -> Column:
    """The text up to the first ``mark``, trimmed; null is empty. What follows it, a recognised section, is left out."""
    return F.regexp_replace(F.substring_index(F.coalesce(text, F.lit("")), mark, 1), r"^\s+|\s+$", "")


def differs(old: Column, new: Column, columns: Sequence[str], json: Sequence[str] = (), marked: Sequence[str] = (), mark: str = "") -> Column:
    """True if a field of struct ``new`` is not that of ``old``: nulls equal nulls, ``json`` fields are compared as
    canonical JSON, ``marked`` ones up to the mark."""

    def form(row: Column, name: str) -> Column:
        value = row[name]
        return canonical_json(value) if name in json else before_mark(value, mark) if name in marked else value

    return reduce(lambda a, b: a | b, (~form(old, c).eqNullSafe(form(new, c)) for c in columns), F.lit(False))


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new table at ``path``. Keys are unique."""
    dealt = rows.withColumn("bucket", bucket_of(key, buckets))
    dealt.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)
    # a bucket of no rows, which tells an empty table's columns
    rows.limit(0).coalesce(1).write.parquet(f"{path.rstrip('/')}/bucket=-1")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).drop("bucket")


def merge(spark: SparkSession, path: str, load: DataFrame, key: Sequence[str], buckets: int = BUCKETS, json: Sequence[str] = (), marked: Sequence[str] = (), mark: str = "") -> dict[str, int]:
    """Put the rows of ``load`` (the table's columns; each key once) into the table: {insert, update, skip} rows, and how
    many buckets were written."""
    columns = [c for c in load.columns if c not in key]
    fresh = load.withColumn("bucket", bucket_of(key, buckets)).persist()
    touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
    table = spark.read.parquet(path)
    old = table.where(F.col("bucket").isin(touched))
    pack = lambda df, name: df.select("bucket", *key, F.struct(*columns).alias(name))
    both = pack(old, "old").join(pack(fresh, "new"), ["bucket", *key], "full")
    change = F.when(F.col("new").isNull(), "keep").when(F.col("old").isNull(), "insert").when(differs(F.col("old"), F.col("new"), columns, json, marked, mark), "update").otherwise("skip")
    decided = both.withColumn("change", change).persist()
    counted = decided.groupBy("bucket", "change").count().collect()
    found = {kind: sum(r["count"] for r in counted if r.change == kind) for kind in ("insert", "update", "skip")}
    changed = sorted({r.bucket for r in counted if r.change in ("insert", "update")})
    if changed:
        rows = decided.where(F.col("bucket").isin(changed)).withColumn("row", F.when(F.col("change").isin("insert", "update"), F.col("new")).otherwise(F.col("old")))
        aside = f"{path.rstrip('/')}-merging-{uuid.uuid4().hex}"
        rows.select(*key, *(F.col(f"row.{c}").alias(c) for c in columns), "bucket").repartition(len(changed), "bucket").write.partitionBy("bucket").parquet(aside)
        whole = spark.read.schema(table.schema).parquet(aside)
        whole.select(*table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(aside)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    decided.unpersist()
    fresh.unpersist()
    return found | {"buckets": len(changed)}
