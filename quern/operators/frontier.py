"""What can be reached from some pages by links, in the order in which a reader who follows them breadth first comes to it.

Each round's pages are written to a folder of their own and are all that the next one starts from, so a run that is cut off
goes on where it was, and no plan grows with the depth. Pages that were seen are kept out by an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reached(links: DataFrame, starts: DataFrame, folder: str, most_depth: int | None = None) -> DataFrame:
    """(page, depth, trail) from links (page, place, target) and starts (page, place): places are unique within a page and among the
    starts. trail holds the places from the start on, so that (depth, trail) is the order of a breadth-first loop. ``folder``
    takes the rounds; it is new, or that of a run to be gone on with. A page that no link leads to has no row."""
    spark = links.sparkSession
    kind = links.schema["page"].dataType.simpleString()
    schema = f"page {kind}, trail array<long>"
    hop = links.where(F.col("target").isNotNull()).select(F.col("page").alias("from"), F.col("place").cast("long").alias("place"), F.col("target").alias("page"))

    def stored(depth: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/depth={depth}")

    def done(depth: int) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/depth={depth}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    depth = 0
    while True:
        if not done(depth):
            if depth == 0:
                found = starts.select("page", F.array(F.col("place").cast("long")).alias("trail"))
            else:
                seen = spark.read.schema(schema + ", depth int").parquet(folder).where(F.col("depth") < depth).select("page")
                step = stored(depth - 1).select(F.col("page").alias("from"), "trail").join(hop, "from").select("page", F.array_append("trail", F.col("place")).alias("trail"))
                found = step.join(seen, "page", "left_anti")
            found.groupBy("page").agg(F.min("trail").alias("trail")).write.mode("overwrite").parquet(f"{folder}/depth={depth}")
        if stored(depth).isEmpty() or depth == most_depth:
            break
        depth += 1
    return spark.read.schema(schema + ", depth int").parquet(folder).where(F.col("depth") <= depth).select("page", "depth", "trail")
