"""Benchmark items within documents, by SimHash over windows of the items' sizes.

Words are lower-case runs of letters, digits and underscores; shingles are WORDS of them (a shorter
item is one shingle). Over each document slide windows that have as many shingles as an item; a document
of fewer shingles, but enough to reach the similarity, is one window as a whole. A window
is fingerprinted if enough of its shingles are shingles of items of its size: fewer cannot reach the
similarity with any. Fingerprints meet in an index of BLOCKS blocks of bits: two that differ in at most RADIUS
bits differ in at most as many, divided by BLOCKS, in some block, and the index holds every item under all block
values that near, so all within the radius are found. Candidates are then verified by the exact
similarity of the shingles, weighted by how often they occur: shared weight over joint weight.

The benchmark is taken in parts of at most PART_CHARS characters, each broadcast to one pass over
the documents, so its size is not bound by memory; what a part builds is a few numbers for each of its
shingles. Equal windows of many documents are matched once.

Fingerprints of texts at similarity s differ in about 64·acos(2s/(1+s))/pi bits: 10 at 0.8, with a
deviation of 3, so RADIUS finds all but about one in a thousand of the pairs just at 0.8, and more above.

Defined results: null and empty texts and items match nothing; repeated rows and repeated items give
a row for each pair of ids; a null id is kept as such; of equally similar windows the first counts;
other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, prepare, relieve_executors, texts

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Characters of the benchmark that one pass takes, and which may become about thirty bytes each.
PART_CHARS = 4 << 20
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + n])) for i in range(len(words) - n + 1)], np.uint64)


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the shingles start … start + size - 1, for each start; repeats count again."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits((sums[starts + size] - sums[starts]) * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def least_shared(size: int, similarity: float, other: int | None = None) -> int:
    """Shingles that two bags of ``size``, or of ``size`` and ``other``, share at least if they are that similar."""
    return int(np.ceil(similarity / (1 + similarity) * (size + (size if other is None else other)) - 1e-9))


class Items:
    """One part of the benchmark: its words, shingles and window sizes."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float) -> None:
        self.number: dict[str, int] = {}
        self.similarity = similarity
        self.found = []
        sizes: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in rows:
            if words := words_of(text):
                n = min(WORDS, len(words))
                hashes = shingle_hashes(words, n)
                self.found.append((item_id, n, len(hashes), int(window_fingerprints(hashes, np.array([0]), len(hashes)).view(np.int64)[0]), hashes.view(np.int64).tolist()))
                ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint64)
                sizes[n].append((len(hashes), np.unique(self.codes(ids, n))))
        # for each length of shingles: their codes, where the sizes of each code start, these, and all sizes
        self.by_length = {}
        for n, own in sizes.items():
            codes, size = np.concatenate([c for _, c in own]), np.repeat([s for s, _ in own], [len(c) for _, c in own])
            order = np.lexsort((size, codes))
            codes, size = codes[order], size[order]
            first = np.r_[True, (codes[1:] != codes[:-1]) | (size[1:] != size[:-1])]
            codes, size = codes[first], size[first]
            names, starts = np.unique(codes, return_index=True)
            self.by_length[n] = names, np.r_[starts, len(codes)], size

    @staticmethod
    def codes(ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n word numbers; 0 if a word of it is of no item."""
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        every = np.ones(len(out), bool)
        with np.errstate(over="ignore"):
            for i in range(n):
                part = ids[i : i + len(out)]
                out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
                every &= part > 0
        return np.where(every, out | np.uint64(1), np.uint64(0))

    def windows(self, text: str) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(words of a shingle, shingles, start, fingerprint, hashes) of windows that may match."""
        words = words_of(text)
        ids = np.array(list(map(self.number.get, words, [0] * len(words))), np.uint64)
        for n, (wanted, starts, size_of) in self.by_length.items():
            own = self.codes(ids, n)
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            places = np.flatnonzero((wanted[at] == own) & (own > 0))
            # places by the window sizes of the items that have the shingle there
            low, high = starts[at[places]], starts[at[places] + 1]
            count = high - low
            rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            mine, place = size_of[rows], np.repeat(places, count)
            order = np.argsort(mine, kind="stable")
            mine, place = mine[order], place[order]
            edges = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True]) if len(mine) else []
            for first, last in zip(edges, edges[1:]):
                yield from self._of_size(n, int(mine[first]), place[first:last], words, len(own))

    def _of_size(self, n: int, size: int, places: np.ndarray, words: list[str], total: int) -> Iterator[tuple]:
        """The windows of one size, by the places of the shingles that items of it have."""
        if size > total:
            # all of a document that is shorter than the item
            if total >= self.similarity * size - 1e-9 and len(places) >= least_shared(size, self.similarity, total):
                hashes = shingle_hashes(words, n)
                yield n, size, 0, window_fingerprints(hashes, np.array([0]), len(hashes))[0], hashes
            return
        least = least_shared(size, self.similarity)
        if len(places) < least:
            return
        hit = np.zeros(total, np.int64)
        hit[places] = 1
        counted = np.r_[0, np.cumsum(hit)]
        starts = np.flatnonzero(counted[size:] - counted[:-size] >= least)
        # windows that overlap share their hashes
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1) if len(starts) else []:
            low = group[0]
            hashes = shingle_hashes(words[low : group[-1] + size + n - 1], n)
            for start, fp in zip(group, window_fingerprints(hashes, group - low, size)):
                yield n, size, int(start), fp, hashes[start - low : start - low + size]


def _windows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"].to_pylist()):
                rows.extend((i, n, size, start, int(fp.view(np.int64)), hashes.view(np.int64)) for n, size, start, fp, hashes in items.windows(text))
            for low in range(0, len(rows), 5000):
                some = rows[low : low + 5000]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array([r[0] for r in some])), *(pa.array([r[i] for r in some], pa.int64()) for i in (1, 2, 3, 4)), pa.array([r[5] for r in some], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "size", "start", "fp", "shingles"],
                )

    return run


def weighted_similarity(a: list[int], b: list[int]) -> float:
    left, right = Counter(a), Counter(b)
    shared = sum((left & right).values())
    return shared / (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [weighted_similarity(a, b) for a, b in zip(batch["shingles"].to_pylist(), batch["own"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["window"], batch["item_id"], pa.array(found, pa.float64())], names=["window", "item_id", "similarity"])


def block_values(fp: str, near: int) -> F.Column:
    """(block, value) for BLOCKS blocks of bits, with every value within ``near`` bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]

    def block(i: int) -> F.Column:
        width = edges[i + 1] - edges[i]
        masks = [sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(width), k)]
        value = F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
        flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")
        return F.transform(flips, lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(block(i) for i in range(BLOCKS))))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each document and item the best window."""
    spark = prepare(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // PART_CHARS))
    found = None
    for number in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == number).collect()  # in bounds: PART_CHARS on average
        part = _contaminated(docs, Items([(r.item_id, r.text) for r in rows], similarity), similarity, radius)
        found = part if found is None else found.unionByName(part)
    return found


def _contaminated(docs: DataFrame, items: Items, similarity: float, radius: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(items)
    seen = texts(docs, "doc_id").mapInArrow(_windows(shared), f"doc_id {kind}, n long, size long, start long, fp long, shingles array<long>")
    seen = cut_lineage(seen.withColumn("window", F.sha2(F.concat_ws(",", F.col("shingles").cast("array<string>")), 256)))
    relieve_executors(spark)
    own = spark.createDataFrame(items.found, "item_id long, n long, size long, fp long, own array<long>").withColumnRenamed("fp", "item_fp")
    index = own.select("item_id", "n", "size", F.explode(block_values("item_fp", radius // BLOCKS)).alias("at")).select("item_id", "n", "size", "at.block", "at.value")
    # a whole document may be a window for items of several sizes
    distinct = seen.groupBy("window", "n", "fp").agg(F.first("shingles").alias("shingles"), F.collect_set("size").alias("sizes"))
    probes = distinct.select("window", "n", F.explode("sizes").alias("size"), "fp").withColumn("at", F.explode(block_values("fp", 0))).select("window", "n", "size", "fp", "at.block", "at.value")
    candidates = probes.join(index, ["n", "size", "block", "value"]).select("window", "item_id", "fp").distinct()
    near = candidates.join(own.select("item_id", "item_fp", "own").dropDuplicates(), "item_id").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    full = near.join(distinct.select("window", "shingles"), "window").select("window", "item_id", "shingles", "own")
    verified = full.mapInArrow(_verify, "window string, item_id long, similarity double").where(F.col("similarity") >= similarity)
    best = F.struct(F.col("similarity"), -F.col("start"))
    hits = seen.select("doc_id", "start", (F.size("shingles") + F.col("n") - 1).alias("words"), "window").join(verified, "window")
    grouped = hits.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("start", best).alias("start_word"), F.max_by("words", best).alias("n_words"))
    return grouped.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    marked = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("marked_id")).distinct()
    return docs.join(marked, docs["doc_id"].eqNullSafe(F.col("marked_id")), "left_anti")
