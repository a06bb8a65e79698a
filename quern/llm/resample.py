"""Importance resampling towards a target's distribution of hashed word runs.

A text's features are its runs of one to three consecutive words, each hashed by CRC-32 into one of ``buckets``
buckets; the words and the hashes come from the texts' UTF-8 buffers by a byte automaton (``byte_words``). A bucket's
gain is the logarithm of how much likelier it is in the target than in the documents, both smoothed by one, in
thousandths and rounded down; a document's weight is the sum of its features' gains. Adding noise of the Gumbel
distribution and taking the highest sums draws without replacement in proportion to the weights' exponentials; the
noise comes from the document's id, so the draw is the same at every run.

Counts are summed in each task before they are shuffled: at most ``buckets`` rows a task. Only the gains, one for
each bucket, go through the driver. Ranks come from a sort by ranges, whose parts are numbered on from the counts of
the parts before; no task holds more than its range.

Defined results: a null or empty text has no features and the weight 0; repeated rows each give a row, are counted
each and may be drawn each; rows that tie in score and id follow each other in any order, a missing id counts as
empty text and comes last among ties; columns besides the id and the text are ignored; an empty table gives an empty
result, and an empty target gives every bucket the gain of its smoothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.byte_words import blocks, letters, run_crcs, spans
from quern.llm.common import cut_lineage, prepare, texts

#: Bytes that belong to words once A-Z are in lower case: digits, a-z and all of other letters' bytes.
WORD_BYTES = letters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
BUCKETS, LONGEST_RUN = 10_000, 3


def _count(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch["text"]):
                for _, crc in run_crcs(data, *spans(data, offsets, WORD_BYTES), longest):
                    totals += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(totals[held])], names=["bucket", "n"])

    return run


def _weigh(gains: np.ndarray, longest: int, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for first, data, offsets in blocks(batch["text"]):
                starts, ends, row = spans(data, offsets, WORD_BYTES)
                rows = len(offsets) - 1
                n_words[first : first + rows] = np.bincount(row, minlength=rows)
                for own, crc in run_crcs(data, starts, ends, row, longest):
                    # rows are in order, so that a row's sum is a difference of running sums of whole numbers
                    running = np.concatenate([[0], np.cumsum(gains[crc % np.uint32(len(gains))])])
                    edges = np.searchsorted(own, np.arange(rows + 1))
                    n_features[first : first + rows] += np.diff(edges)
                    weight[first : first + rows] += np.diff(running[edges])
            yield pa.RecordBatch.from_arrays([batch[id_column], *map(pa.array, (n_words, n_features, weight))], names=[id_column, "n_words", "n_features", "weight"])

    return run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n) of all features of all rows; buckets without any have no row."""
    counted = texts(docs, text=text).mapInArrow(_count(buckets, longest), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, gain) of every bucket."""
    own = bucket_counts(docs, buckets=buckets, longest=longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, buckets=buckets, longest=longest).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = cut_lineage(own.unionByName(wanted).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the first 32 bits of the id's SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _number(offsets: dict[int, int], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(before + 1, before + 1 + batch.num_rows))], names=[*columns, "rank"])
            before += batch.num_rows

    return run


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with rank, 1, 2, 3, … over all of them in the given order, by a sort in ranges."""
    parts = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = {r[0]: r[1] for r in parts.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    offsets, before = {}, 0
    for part in sorted(counts):
        offsets[part], before = before, before + counts[part]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return parts.mapInArrow(_number(offsets, rows.columns), f"{schema}, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_column: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row: rank is the place in the draw of floor(percent * N
    / 100) of the N rows with ``least_words`` words, null for rows that are not drawn. Texts are in the column text."""
    prepare(docs.sparkSession)
    table = np.zeros(buckets, np.int64)
    for r in gains(docs, target, buckets, longest).collect():
        table[r.bucket] = r.gain
    kind = docs.schema[id_column].dataType.simpleString()
    weighed = texts(docs, id_column).mapInArrow(_weigh(table, longest, id_column), f"`{id_column}` {kind}, n_words long, n_features long, weight long")
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col(id_column), seed)))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    places = ranked(enough, F.desc("score"), F.asc_nulls_last(id_column))
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return places.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
