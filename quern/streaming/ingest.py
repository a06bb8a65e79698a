"""Incremental ingestion: documents to chunks to an index, and metrics of a log, as streams.

The batch functions are those that the stream applies, so a stream that has caught up holds what one
batch over all its input would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import texts
from quern.operators import merge

DOCUMENT = "doc_id long, text string, version timestamp"


def chunks_of(documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, version, chunk_no, content, content_hash)."""
    exploded = documents.select("doc_id", "version", F.posexplode(texts.paragraph_chunks(F.col("text"))).alias("chunk_no", "content"))
    return exploded.select(F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), "doc_id", "version", "chunk_no", "content", texts.fingerprint(F.col("content")).alias("content_hash"))


def latest_versions(documents: DataFrame) -> DataFrame:
    """Each document's last version, of equally late ones the greater text."""
    return documents.groupBy("doc_id").agg(F.max(F.struct("version", "text")).alias("d")).select("doc_id", "d.text", "d.version")


def ingest(spark: SparkSession, source: str, index: str, checkpoint: str) -> StreamingQuery:
    """Every new file of documents goes as chunks to the index, in a folder a batch, so that a batch that
    is run again replaces what it wrote; `current_index` reads the latest version of each document."""
    documents = spark.readStream.schema(DOCUMENT).json(source)

    def write(batch: DataFrame, number: int) -> None:
        chunks_of(latest_versions(batch)).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of each document's last version, of versions ingested twice the last batch's."""
    written = spark.read.parquet(index)
    last = written.groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("last"))
    return written.join(last, "doc_id").where(F.struct("version", "batch") == F.col("last")).drop("last", "batch")


def windowed_metrics(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means by window and type over (event_id, ts, event_type, value); repeated ids count once
    within the watermark, later rows than that are left out."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")


#: What is kept of each document: its last version, how its embedding went and how often it was tried.
STATE = "doc_id long, text string, version timestamp, status string, attempts int, chunks int, batch long"


def hashed_vectors(chunks: DataFrame, dimensions: int = 384) -> DataFrame:
    """``chunks`` with vector, the signed hashed words at unit length by dimension (map<int,double>). Chunks without words
    have an empty one."""
    words = chunks.select("chunk_id", F.explode(texts.word_tokens(F.col("content"))).alias("word")).groupBy("chunk_id", "word").agg(F.count("*").alias("n"))
    summed = words.select("chunk_id", "n", texts.signed_feature(F.col("word"), dimensions).alias("f")).groupBy("chunk_id", "f.dimension").agg(F.sum(F.col("f.sign") * F.col("n")).cast("double").alias("v")).where("v <> 0")
    vectors = summed.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("dimension", "v"))).alias("entries"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    made = vectors.select(F.col("chunk_id").alias("of"), F.map_from_entries(F.transform("entries", lambda e: F.struct(e["dimension"], e["v"] / F.col("norm")))).alias("vector"))
    empty = F.create_map().cast("map<int,double>")
    return chunks.join(made, F.col("chunk_id") == F.col("of"), "left").drop("of").withColumn("vector", F.coalesce("vector", empty))


def embed_pending(spark: SparkSession, state: str, index: str, number: int, embed: Callable[[DataFrame], DataFrame] = hashed_vectors, most_attempts: int | None = None) -> dict[str, int]:
    """Take every document of the state that is not SUCCESS: cut it, embed it, write its chunks with their vectors into the
    folder of batch ``number`` and mark it. ``embed`` adds the column vector; a document of which any chunk has a null one
    is FAILED, has no chunks written, and is taken again next time, or until it was tried ``most_attempts`` times.
    Returns how many were taken, went well and failed, and the chunks written."""
    every = merge.stored(spark, state).where("status <> 'SUCCESS'")
    pending = every if most_attempts is None else every.where(F.col("attempts") < most_attempts)
    pending = pending.persist()
    chunks = embed(chunks_of(pending.select("doc_id", "text", "version"))).persist()
    per = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("made"), F.bool_or(F.col("vector").isNull()).alias("broken"))
    judged = pending.join(per, "doc_id", "left").withColumn("good", ~F.coalesce("broken", F.lit(False)))
    status = F.when(F.col("good"), "SUCCESS").otherwise("FAILED")
    after = judged.select("doc_id", "text", "version", status.alias("status"), (F.col("attempts") + 1).alias("attempts"), F.when(F.col("good"), F.coalesce("made", F.lit(0))).otherwise(0).alias("chunks"), F.lit(number).cast("long").alias("batch")).persist()
    good = after.where("status = 'SUCCESS'").select("doc_id")
    # the index first: a batch that is cut off in between is taken again, into the same folder
    chunks.join(good, "doc_id", "left_semi").select("chunk_id", "doc_id", "version", "chunk_no", "content", "content_hash", "vector").write.mode("overwrite").parquet(f"{index}/batch={number}")
    r = after.agg(F.count("*"), F.count_if(F.col("status") == "SUCCESS"), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    merge.merge(spark, state, after, ["doc_id"])
    for held in (pending, chunks, after):
        held.unpersist()
    return {"total": r[0], "success": r[1], "failed": r[0] - r[1], "chunks": r[2]}


def ingest_with_state(spark: SparkSession, source: str, index: str, state: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = hashed_vectors, stats: list | None = None) -> StreamingQuery:
    """Every new file of documents goes into the state, changed ones as PENDING, and then all that are not SUCCESS are
    embedded, those that failed before among them. A document that comes again as it was keeps its status; an older
    version than the state's is passed over. Each batch's counts are appended to ``stats``."""
    documents = spark.readStream.schema(DOCUMENT).json(source)

    def write(batch: DataFrame, number: int) -> None:
        latest = latest_versions(batch)
        known = merge.stored(spark, state).select("doc_id", F.col("version").alias("known_version"), F.col("text").alias("known_text"))
        same = F.col("known_version").isNotNull() & ((F.col("version") < F.col("known_version")) | F.col("text").eqNullSafe(F.col("known_text")))
        new = latest.join(known, "doc_id", "left").where(~same)
        rows = new.select("doc_id", "text", "version", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("chunks"), F.lit(number).cast("long").alias("batch"))
        merge.merge(spark, state, rows, ["doc_id"])
        found = embed_pending(spark, state, index, number, embed)
        if stats is not None:
            stats.append(found)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_state(spark: SparkSession, path: str, documents: DataFrame | None = None) -> None:
    """A state at ``path``, empty or with documents (doc_id, text, version) to begin with."""
    rows = spark.createDataFrame([], STATE) if documents is None else documents.select("doc_id", "text", "version", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("chunks"), F.lit(-1).cast("long").alias("batch"))
    merge.create(rows, path, ["doc_id"])
