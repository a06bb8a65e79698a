"""Ranked lexical search by an index of two levels.

The index is cut by documents: a segment holds the postings of some SEGMENT_WORDS words of text, sorted by term. Its
first level is one byte for each posting, the posting's impact rounded up to a multiple of STEP; its second level is
the exact number of occurrences, and each document's number of terms. A query adds up weights times bytes for all
documents of a segment at once, which bounds every document's score from above and, with the bytes less one, from
below. Every document whose upper bound reaches the k-th highest lower bound is scored anew in exact whole numbers
from the second level, so the result is that of scoring everything. Segments are searched apart; only the k best of
a segment for a query leave it, and of those the k best are taken for each query.

Building reads the texts twice: once for the number of documents and terms, which impacts depend on, and once for
the postings, which stay in their task and are never shuffled. Queries pass through the driver in parts of PART_BYTES
of text (a longer one is a part by itself), one pass over the index each, for which the index's terms and counts
are read first to learn the queries' document frequencies. Terms are compared by 64-bit hashes.

Defined results: a null or empty text, and one of signs only, has no terms, counts nowhere and is never found; a
query without terms finds nothing; repeated rows are documents of their own; equal scores go by ascending id, a
missing id last; columns besides id and text are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.byte_words import blocks, letters, spans, word_hashes
from quern.llm.common import cut_lineage, fresh_folder, prepare, remove, texts

#: Bytes that belong to terms once A-Z are in lower case.
TERM_BYTES = letters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words of a segment, and documents that it may hold at most (their numbers have two bytes).
SEGMENT_WORDS, SEGMENT_DOCS = 1_000_000, 60_000
#: Text of queries that is searched for together.
PART_BYTES = 2 << 20
# Fixed values of the score: its scale, how fast repetitions and length count, and the share of length.
SCALE, LENGTH_FACTOR, LENGTH_SHARE = 1_000_000_000, 12, 25
#: Impacts are below a million: 255 steps cover them.
STEP = 3_922

SCHEMA = "docs array<{kind}>, n binary, terms binary, starts binary, ordinals binary, impacts binary, tf binary"


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence count adds to a score for each unit of its term's weight, in whole numbers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + LENGTH_FACTOR * m)


@dataclass
class Segment:
    """Postings of some documents: those of term i are at starts[i] … starts[i + 1], by document."""

    docs: pa.Array
    n: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    ordinals: np.ndarray
    impacts: np.ndarray
    tf: np.ndarray

    @classmethod
    def built(cls, ids: list[pa.Array], words: list[np.ndarray], rows: list[np.ndarray], n_docs: int, n_terms: int) -> Segment:
        docs = pa.concat_arrays(ids)
        codes, found = pd.factorize(np.concatenate(words))
        order = np.argsort(found)
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        row = np.concatenate(rows)
        keys = np.sort((rank[codes] << 16) | row)
        first = np.flatnonzero(np.diff(keys, prepend=np.int64(-1)))
        tf, held = np.diff(np.append(first, len(keys))), keys[first]
        ordinals, n = held & 0xFFFF, np.bincount(row, minlength=len(docs))
        exact = impact(tf, n[ordinals], n_docs, max(1, n_terms))
        starts = np.searchsorted(held >> 16, np.arange(len(found) + 1))
        return cls(docs, n, np.asarray(found)[order], starts, ordinals.astype(np.uint16), (-(-exact // STEP)).astype(np.uint8), tf.astype(np.uint32))

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        parts = (self.n.astype(np.int64), self.terms, self.starts.astype(np.int64), self.ordinals, self.impacts, self.tf)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(self.docs)], pa.int32()), self.docs.cast(kind)), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "n", "terms", "starts", "ordinals", "impacts", "tf"])

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Segment:
        kinds = {"n": np.int64, "terms": np.uint64, "starts": np.int64, "ordinals": np.uint16, "impacts": np.uint8, "tf": np.uint32}
        return cls(batch["docs"][i].values, **{k: np.frombuffer(batch[k][i].as_buffer(), kind) for k, kind in kinds.items()})

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term stands among the segment's, -1 for those that it does not hold."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def best(self, places: np.ndarray, weights: np.ndarray, k: int, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents' numbers, exact scores, documents scored exactly) of the k best with a score above 0."""
        lists = [(slice(self.starts[p], self.starts[p + 1]), w) for p, w in zip(places.tolist(), weights.tolist()) if p >= 0 and w > 0]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        own = np.concatenate([self.ordinals[s] for s, _ in lists])
        high = np.concatenate([self.impacts[s] for s, _ in lists]).astype(np.int64) * STEP
        scale = np.repeat([w for _, w in lists], [s.stop - s.start for s, _ in lists])
        # sums of whole numbers far below 2 ** 53, so the sums in doubles are exact
        upper = np.bincount(own, high * scale, len(self.n))
        lower = np.bincount(own, np.maximum(high - STEP + 1, 0) * scale, len(self.n))
        bound = np.partition(lower, -k)[-k] if len(lower) > k else 0
        chosen = np.flatnonzero((upper >= bound) & (upper > 0))
        scores = np.zeros(len(chosen), np.int64)
        for s, w in lists:
            at = np.searchsorted(self.ordinals[s], chosen)
            held = np.flatnonzero(at < s.stop - s.start)
            held = held[self.ordinals[s][at[held]] == chosen[held]]
            scores[held] += w * impact(self.tf[s][at[held]].astype(np.int64), self.n[chosen[held]], n_docs, n_terms)
        return chosen[scores > 0], scores[scores > 0], len(chosen)


@dataclass
class Index:
    """Where the segments are stored, the documents with terms, and all their terms."""

    path: str
    n_docs: int
    n_terms: int
    kind: str


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_docs = n_terms = 0
    for batch in batches:
        for _, data, offsets in blocks(batch["text"]):
            starts, _, row = spans(data, offsets, TERM_BYTES)
            n_docs, n_terms = n_docs + int(np.count_nonzero(np.diff(row, prepend=-1))), n_terms + len(starts)
    yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])


def _segments(n_docs: int, n_terms: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, rows, size, docs, kind = [], [], [], 0, 0, None
        for batch in batches:
            kind = batch["id"].type
            for first, data, offsets in blocks(batch["text"]):
                starts, ends, row = spans(data, offsets, TERM_BYTES)
                full, numbers = np.unique(row, return_inverse=True)
                for low in range(0, len(full), SEGMENT_DOCS):
                    some = slice(*np.searchsorted(numbers, [low, low + SEGMENT_DOCS]))
                    own = full[low : low + SEGMENT_DOCS]
                    if docs and (docs + len(own) > SEGMENT_DOCS or size >= words):
                        yield Segment.built(ids, held, rows, n_docs, n_terms).row(kind)
                        ids, held, rows, size, docs = [], [], [], 0, 0
                    ids.append(batch["id"].take(pa.array(own + first)))
                    held.append(word_hashes(data, starts[some], ends[some]))
                    rows.append(numbers[some] - low + docs)
                    size, docs = size + len(held[-1]), docs + len(own)
        if docs:
            yield Segment.built(ids, held, rows, n_docs, n_terms).row(kind)

    return run


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> Index:
    """The index of all rows, stored in the shared folder."""
    spark = prepare(docs.sparkSession)
    base = texts(docs.withColumnRenamed(id_column, "id") if id_column != "id" else docs, "id", text=text)
    kind = base.schema["id"].dataType.simpleString()
    total = base.select("text").mapInArrow(_sizes, "n_docs long, n_terms long").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    path = fresh_folder(spark, "lexical-index")
    base.mapInArrow(_segments(total[0], total[1], segment_words), SCHEMA.format(kind=kind)).write.option("compression", "zstd").parquet(path)
    return Index(path, total[0], total[1], kind)


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch["terms"], batch["starts"]):
                held, edges = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), np.int64)
                at = np.searchsorted(held, terms)
                there = np.flatnonzero(at < len(held))
                there = there[held[at[there]] == terms[there]]
                found[there] += np.diff(edges)[at[there]]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["term", "df"])

    return run


def _search(queries: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, weights: np.ndarray, k: int, n_docs: int, n_terms: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment.of(batch, i)
                places = segment.places(terms)
                items, docs, scores = [], [], []
                for item, (own, times) in enumerate(queries):
                    found, score, _ = segment.best(places[own], weights[own] * times, k, n_docs, n_terms)
                    ids = segment.docs.take(pa.array(found)).to_pylist()
                    top = sorted(zip(-score, ids), key=lambda x: (x[0], x[1] is None, x[1]))[:k] if len(ids) else []
                    items += [item] * len(top)
                    docs += [d for _, d in top]
                    scores += [-int(s) for s, _ in top]
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, segment.docs.type), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def parts_of(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(id, text) of the queries in lists of about ``most`` bytes of text."""
    part, size = [], 0
    for row in queries.toLocalIterator():
        n = len(row[1].encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    if part:
        yield part


def query_terms(part: list[tuple]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All terms of the queries, sorted, and for each query its terms' places among them and how often it has each."""
    hashes = []
    for first, data, offsets in blocks(pa.array([t for _, t in part], pa.large_string())):
        starts, ends, row = spans(data, offsets, TERM_BYTES)
        edges = np.searchsorted(row, np.arange(len(offsets)))
        found = word_hashes(data, starts, ends)
        hashes += [found[a:b] for a, b in zip(edges, edges[1:])]
    terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return terms, [np.unique(np.searchsorted(terms, h), return_counts=True) for h in hashes]


def _weights(spark: SparkSession, terms: np.ndarray, index: Index) -> np.ndarray:
    """Each term's weight, from its document frequency in the whole index. Terms of no document weigh nothing."""
    counted = spark.read.parquet(index.path).select("terms", "starts").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (F.lit(2) * F.lit(index.n_docs) + 2).cast("double") / (F.lit(2) * F.col("df") + 1).cast("double")
    weights = np.zeros(len(terms), np.int64)
    for r in counted.select("term", F.floor(F.lit(1000) * F.log(ratio)).cast("long").alias("weight")).collect():
        weights[r.term] = r.weight
    return weights


def search(index: Index, queries: DataFrame, k: int = 20, id_column: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, rank, doc_id, score): each query's ``k`` documents of the highest scores above 0."""
    spark = prepare(queries.sparkSession)
    name = queries.schema[id_column].dataType.simpleString()
    found = None
    for part in parts_of(texts(queries, id_column, text=text), part_bytes):
        terms, own = query_terms(part)
        if not len(terms) or not index.n_docs:
            continue
        weights = _weights(spark, terms, index)
        scan = _search(own, terms, weights, k, index.n_docs, index.n_terms, index.kind)
        hits = spark.read.parquet(index.path).mapInArrow(scan, f"item int, doc_id {index.kind}, score long")
        first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q[0]) for i, q in enumerate(part)], f"item int, `{id_column}` {name}")
        top = cut_lineage(top.join(F.broadcast(names), "item").select(id_column, "rank", "doc_id", "score"))
        found = top if found is None else found.unionByName(top)
    return spark.createDataFrame([], f"`{id_column}` {name}, rank int, doc_id {index.kind}, score long") if found is None else found


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``search`` in an index of ``docs`` that is deleted afterwards."""
    index = build(docs)
    found = search(index, queries, k)
    remove(docs.sparkSession, index.path)
    return found
