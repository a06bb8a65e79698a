"""What the operators of this subpackage share: splits, shared folders, batch limits, clean inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch hands to Python, at most; one row may have more.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20
#: Share of the driver's heap that may be taken before its garbage is collected where a result is stored, and the percentages of
#: free heap, at least and at most, that such a collection leaves.
HEAP_SHARE, LEAST_FREE, MOST_FREE = 0.4, 20, 40


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session; the operators call it before they use Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def texts(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Only ``columns`` and the text, nulls as empty text: columns of other names never get in the way."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local tests a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-shared")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    stored = df.checkpoint(eager=True)
    collect_garbage(df.sparkSession)
    return stored


def collect_garbage(spark: SparkSession, share: float = HEAP_SHARE) -> None:
    """Collect the driver's garbage if its heap has grown to more than ``share`` of what it may take. The plans of many short
    jobs are nearly all garbage, with which the heap would grow to its limit; the cleaner also deletes the shuffle files
    of results that are gone. By default a collection leaves up to 70 % of the heap free but taken, so for this one MOST_FREE holds."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        collect = spark._jvm.java.lang.System.gc
        before = free_heap(spark, LEAST_FREE, MOST_FREE)
        try:
            collect()
        finally:
            free_heap(spark, *before)


def free_heap(spark: SparkSession, *percent: int) -> tuple[int, ...]:
    """Set the percentages of free heap, at least and at most, that a collection of the driver leaves; the ones before."""
    if not percent:
        return ()
    management = spark._jvm.java.lang.management.ManagementFactory
    bean = management.getPlatformMXBean(spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    if bean is None:  # another maker's Java has no such options
        return ()
    names = ("MinHeapFreeRatio", "MaxHeapFreeRatio")
    before = tuple(int(bean.getVMOption(name).getValue()) for name in names)
    bean.setVMOption(names[0], "0")  # the one at least may never be over the one at most
    for name, value in reversed(list(zip(names, percent))):
        bean.setVMOption(name, str(value))
    return before


def relieve_executors(spark: SparkSession, local: bool = False) -> None:
    """Collect the garbage of every executor, between two large steps. An executor's heap grows with the garbage of all the jobs
    that it has run and stays that large beside the Python workers of the next step; a full collection gives back what is free, with the classes
    of old plans. There is a task for each core, all at once; requests that meet in one process are one collection. In a local
    session the driver is the executor, which `collect_garbage` looks after; else the driver's turn comes as well."""
    if local or not re.match(r"local(\[|$)", spark.sparkContext.master):
        collect_garbage(spark)
        slots = spark.sparkContext.defaultParallelism
        spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def pieces_of(runs: DataFrame, size: int, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, piece, parts): runs (run, rows, columns) put together in order to pieces of about ``size`` rows, so that
    the number of pieces does not follow the number of partitions. Only the runs' numbers are windowed."""
    before = F.sum("rows").over(W.partitionBy(*by).orderBy("run")) - F.col("rows")
    places = runs.select(*by, "run", "rows").withColumn("piece", F.floor(before / size).cast("long")).select("run", *(F.col(c).alias(f"own_{c}") for c in by), "piece")
    same = [F.col(c) == F.col(f"own_{c}") for c in by]
    placed = runs.withColumnRenamed("run", "number").join(places, [F.col("number") == F.col("run"), *same]).drop("number", *(f"own_{c}" for c in by))
    return placed.groupBy(*by, "piece").agg(F.array_sort(F.collect_list(F.struct("run", *columns))).alias("parts"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``fresh_folder`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
