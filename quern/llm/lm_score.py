"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

The filter holds, for each n-gram of up to ``order`` words of the training texts with count c, the items
(n-gram, 1) … (n-gram, q) with q = 1 + floor(log2 c). A count is read back by probing levels until
one is missing, as the middle of the last level's range; it is never read too low, and too high only
by false positives. The probability of a word after those before it is the count of them together, smoothed by
the probability after one word fewer, in the end by the word's own add-one probability; a text's score is the
sum of log10 probabilities of its tokens.

The filter is built in buckets by the n-grams' hash: tasks count n-grams of their rows, send them
packed by bucket, and each bucket becomes its own stretch of bits, ``bits`` for each of its items: false
positives are as likely at any size of the input. Buckets are broadcast in ranges of at most ``most_bytes``.
If there are several ranges, the texts' words are hashed and stored once, and each range's pass adds the levels
of the n-grams that it holds; the levels of all passes together are those of one filter. The exact add-one
base score uses exact unigram counts: those of the most frequent words (KEEP_WORDS, of at most WORD_BYTES)
are broadcast, all other words of a text are joined with the counts.

Defined results: a null text is empty and has one token, the end; rows without an id count as their
empty id's fold; repeated rows each give a row, and each is counted when training; without training
rows all counts are zero; columns besides the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, fresh_folder, prepare, remove, texts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: No word holds white space, so these are free to stand for the end of a text and its start.
END, START = b" ", b"  "
#: Words of the broadcast exact counts, and the longest of them in bytes.
KEEP_WORDS, WORD_BYTES = 200_000, 64
#: Tokens whose n-grams a task combines before it sends them on, and tokens for each bucket.
FLUSH_TOKENS, BUCKET_TOKENS = 4_000_000, 500_000
#: Levels that a count may have, and probes for each.
LEVELS, PROBES = 40, 3


@dataclass(frozen=True)
class Model:
    """Bits of the filter for each item, bytes of it that are broadcast at once, the smoothing weight, and the
    words of the longest n-grams."""

    bits: int = 6
    most_bytes: int = 256 << 20
    weight: float = 50.0
    order: int = 2


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(left) * np.uint64(3) + right)


def tokens_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(counts)).astype(np.int64))


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(q-1) … 2^q - 1; none for level 0."""
    return np.where(levels > 0, (1.5 * 2.0 ** (levels - 1) - 0.5), 0.0)


def places(h: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.asarray(bits).astype(np.uint64)).astype(np.int64)


@dataclass
class Filter:
    """Buckets of bits from ``low`` on, each for the n-grams whose hash has its number in the top bits; offsets
    are the bytes where they start."""

    words: np.ndarray
    shift: int
    low: int
    offsets: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of the n-grams, 0 for those of other buckets."""
        found = np.zeros(len(h), np.int64)
        bucket = (h >> np.uint64(self.shift)).astype(np.int64) - self.low
        alive = np.flatnonzero((bucket >= 0) & (bucket < len(self.offsets) - 1))
        start = self.offsets[bucket[alive]]
        bits = (self.offsets[bucket[alive] + 1] - start) * 8
        own = h[alive]
        some = bits > 0
        alive, own, start, bits = alive[some], own[some], start[some], bits[some]
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                if not len(alive):
                    return found
                place = places(own, level, probe, bits)
                held = (self.words[start + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
                alive, own, start, bits = alive[held], own[held], start[held], bits[held]
            found[alive] = level
        return found


def text_tokens(whole: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch, the tokens as their numbers, and the tokens of each text; each text ends in END."""
    number = {END: 0}
    ids: list[int] = []
    sizes = np.zeros(len(whole), np.int64)
    for i, text in enumerate(whole):
        words = tokens_of(text)
        for w in words:
            if w not in number:
                number[w] = len(number)
        ids.extend(map(number.__getitem__, words))
        ids.append(0)
        sizes[i] = len(words) + 1
    return list(number), np.array(ids, np.int64), sizes


def grams_of(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For 1 … order words, the hash of the n-gram that ends at each token; before a text come START words."""
    first = np.cumsum(sizes) - sizes
    found, start = [tokens], word_hashes([START])
    before = start
    for _ in range(order - 1):
        previous = np.empty_like(tokens)
        previous[1:] = found[-1][:-1]
        previous[first] = before[0]
        found.append(pair_hashes(previous, tokens))
        before = pair_hashes(before, start)
    return found


def log_probability(levels: list[np.ndarray], sizes: np.ndarray, scale: int, weight: float) -> np.ndarray:
    """The model's log10 probability of each text, by the levels of its tokens' n-grams."""
    counts = [middle(x) for x in levels]
    ends = np.cumsum(sizes)
    chance = (counts[0] + 1) / scale
    for shorter, longer in zip(counts, counts[1:]):
        context = np.empty_like(shorter)
        context[1:] = shorter[:-1]
        context[ends - sizes] = counts[0][ends - 1]  # every text starts once, as often as it ends
        chance = (longer + weight * chance) / (np.maximum(context, longer) + weight)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=np.log10(chance), minlength=len(sizes))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(found: Counter) -> Iterator[pa.RecordBatch]:
        items = list(found.items())
        for low in range(0, len(items), 100_000):
            some = items[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            found.update(tokens_of(text))
        found[END] += batch.num_rows
        if len(found) > FLUSH_TOKENS // 4:
            yield from rows(found)
            found = Counter()
    yield from rows(found)


def unigrams(training: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the training texts, the end among them."""
    return training.select("text").mapInArrow(_unigrams, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _packed(hashes: np.ndarray, counts: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
    """n-grams by bucket, as bytes: hashes of those of count 1, of the others, and their counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    buckets = (hashes >> np.uint64(shift)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(hashes) else np.array([], int)
    rows = [(int(buckets[a]), hashes[a:b], counts[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(hashes)])]
    for low in range(0, len(rows), 256):
        some = rows[low : low + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some], pa.int64()), *(pa.array(column, pa.binary()) for column in ([h[n == 1].tobytes() for _, h, n in some], [h[n > 1].tobytes() for _, h, n in some], [n[n > 1].astype(np.int64).tobytes() for _, h, n in some]))],
            names=["bucket", "once", "more", "counts"],
        )


def _longer(shift: int, order: int):
    """n-grams of two words and more, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            words, ids, sizes = text_tokens(batch["text"].to_pylist())
            held += grams_of(word_hashes(words)[ids], sizes, order)[1:]
            size += len(ids) * (order - 1)
            if size >= FLUSH_TOKENS:
                yield from _packed(*np.unique(np.concatenate(held), return_counts=True), shift)
                held, size = [], 0
        if size:
            yield from _packed(*np.unique(np.concatenate(held), return_counts=True), shift)

    return run


def _hashed(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed(word_hashes(batch["word"].to_pylist()), np.asarray(batch["n"]), shift)

    return run


def _bucket(bits_an_item: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["once"]])
        more = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["more"]])
        counts = np.concatenate([np.ones(len(once), np.int64), *(np.frombuffer(x, np.int64) for x in rows["counts"])])
        hashes, place = np.unique(np.concatenate([once, more]), return_inverse=True)
        levels = levels_of(np.bincount(place, weights=counts).astype(np.int64))
        bits = -(-max(1, int(levels.sum())) * bits_an_item // 64) * 64
        held = np.zeros(bits, bool)
        for level in range(1, int(levels.max()) + 1):
            own = hashes[levels >= level]
            for probe in range(PROBES):
                held[places(own, level, probe, bits)] = True
        return pd.DataFrame({"bucket": [key[0]], "size": [bits // 8], "filter": [np.packbits(held, bitorder="little").tobytes()]})

    return run


def build_filter(training: DataFrame, counts: DataFrame, tokens: int, model: Model = Model()) -> tuple[DataFrame, int]:
    """(bucket, size, filter): the filter of the training texts' n-grams and of ``counts``, their unigrams, in stored
    buckets, and how many of a hash's top bits number the bucket."""
    power = max(4, math.ceil(math.log2(max(1, tokens) * max(1, model.order - 1) / BUCKET_TOKENS)))
    shift = 64 - power
    schema = "bucket long, once binary, more binary, counts binary"
    grams = counts.mapInArrow(_hashed(shift), schema)
    if model.order > 1:
        grams = training.select("text").mapInArrow(_longer(shift, model.order), schema).unionByName(grams)
    # stored, since reading partitions one by one would also build them one by one
    return cut_lineage(grams.groupBy("bucket").applyInPandas(_bucket(model.bits), "bucket long, size long, filter binary")), power


def ranges(buckets: DataFrame, power: int, model: Model) -> list[tuple[int, int]]:
    """Bounds of bucket numbers whose bits make up most_bytes at most, give or take the hashes' chance."""
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = min(1 << power, max(1, math.ceil(total / (0.95 * model.most_bytes) if total > model.most_bytes else 1)))
    edges = [(i << power) // count for i in range(count + 1)]
    return list(zip(edges, edges[1:]))


def load_filter(buckets: DataFrame, power: int, low: int, high: int) -> Filter:
    """The buckets low … high - 1; in bounds by ``ranges``."""
    sizes = np.zeros(high - low, np.int64)
    some = buckets.where(F.col("bucket").between(low, high - 1))
    for row in some.select("bucket", "size").toLocalIterator():
        sizes[row.bucket - low] = row.size
    offsets = np.r_[0, np.cumsum(sizes)]
    words = np.zeros(offsets[-1], np.uint8)
    for row in some.select("bucket", "filter").toLocalIterator():
        at = row.bucket - low
        words[offsets[at] : offsets[at + 1]] = np.frombuffer(row.filter, np.uint8)
    return Filter(words, 64 - power, low, offsets)


def _exact(known: dict[bytes, int], scale: int, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> dict:
    """A batch's exact parts: what frequent words give to the base score, and the other words with their counts."""
    n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    token = np.array([known.get(w, -1) for w in words], np.int64)[ids]
    gain = np.bincount(doc, weights=np.where(token >= 0, np.log10(np.maximum(token, 0) + 1), 0.0), minlength=n)
    rest = np.flatnonzero(token < 0)
    keys, times = np.unique(doc[rest] * len(words) + ids[rest], return_counts=True)
    at = pa.array(np.searchsorted(keys // len(words), np.arange(n + 1)), pa.int32())
    return {
        "n_tokens": pa.array(sizes),
        "seen": pa.array(np.bincount(doc, weights=token > 0, minlength=n).astype(np.int64)),
        "base": pa.array(gain - sizes * math.log10(scale)),
        "rare": pa.ListArray.from_arrays(at, pa.array([words[i] for i in keys % len(words)], pa.binary())),
        "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
    }


#: What a row has besides its model score, and the kinds of it.
EXACT = {"n_tokens": "long", "seen": "long", "base": "double", "rare": "array<binary>", "times": "array<long>"}


def _in_one_pass(shared, known, scale: int, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, sizes = text_tokens(batch["text"].to_pylist())
            hashes = word_hashes(words)
            levels = [shared.value.levels(hashes)[ids]]
            for grams in grams_of(hashes[ids], sizes, model.order)[1:]:
                distinct, back = np.unique(grams, return_inverse=True)
                levels.append(shared.value.levels(distinct)[back])
            columns = _exact(known.value, scale, words, ids, sizes) | {"score": pa.array(log_probability(levels, sizes, scale, model.weight))}
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "id", "held_out")), *columns.values()], names=["row", "id", "held_out", *columns])

    return run


def _hashed_tokens(known, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, sizes = text_tokens(batch["text"].to_pylist())
            tokens, ends = word_hashes(words)[ids], np.cumsum(sizes)
            columns = _exact(known.value, scale, words, ids, sizes) | {
                "tokens": pa.array([tokens[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary()),
                "levels": pa.array([b""] * len(sizes), pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "id", "held_out")), *columns.values()], names=["row", "id", "held_out", *columns])

    return run


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.array([], kind)])


def _add_levels(shared, scale: int, model: Model, last: bool):
    """Adds the levels that one range of buckets has; the last pass turns them into scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _joined(batch["tokens"], np.uint64)
            sizes = np.array([len(x) // 8 for x in batch["tokens"].to_pylist()], np.int64)
            rows = [np.frombuffer(x, np.uint8) if x else np.zeros(model.order * n, np.uint8) for x, n in zip(batch["levels"].to_pylist(), sizes)]
            before = np.concatenate([r.reshape(model.order, -1) for r in rows] or [np.zeros((model.order, 0), np.uint8)], axis=1)
            after = []
            for grams, known in zip(grams_of(tokens, sizes, model.order), before):
                distinct, back = np.unique(grams, return_inverse=True)
                after.append(known + shared.value.levels(distinct)[back])
            if last:
                new, name = pa.array(log_probability(after, sizes, scale, model.weight)), "score"
            else:
                found, ends = np.array(after, np.uint8).reshape(model.order, -1), np.cumsum(sizes)
                new, name = pa.array([found[:, e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary()), "levels"
            keep = [c for c in batch.schema.names if c != "levels" and not (last and c == "tokens")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), new], names=[*keep, name])

    return run


def _scored(marked: DataFrame, buckets: DataFrame, power: int, known, scale: int, model: Model) -> DataFrame:
    """(row, id, held_out, …, score) by one pass over the texts, or by one over their hashes for each range."""
    spark = marked.sparkSession
    kind = marked.schema["id"].dataType.simpleString()
    ids = f"row long, id {kind}, held_out boolean, " + ", ".join(f"{c} {k}" for c, k in EXACT.items())
    parts = ranges(buckets, power, model)
    share = lambda part: spark.sparkContext.broadcast(load_filter(buckets, power, *part))
    if len(parts) == 1:
        return marked.mapInArrow(_in_one_pass(share(parts[0]), known, scale, model), f"{ids}, score double")
    state = marked.mapInArrow(_hashed_tokens(known, scale), f"{ids}, tokens binary, levels binary")
    before = None
    for part in parts[:-1]:
        shared, path = share(part), fresh_folder(spark, "lm-levels")
        state.mapInArrow(_add_levels(shared, scale, model, False), f"{ids}, tokens binary, levels binary").write.parquet(path)
        shared.unpersist()
        if before:
            remove(spark, before)
        state, before = spark.read.parquet(path), path
    return state.mapInArrow(_add_levels(share(parts[-1]), scale, model, True), f"{ids}, score double")


def score_texts(docs: DataFrame, held_out: Column, model: Model = Model(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows where ``held_out`` is
    false train the model."""
    spark = prepare(docs.sparkSession)
    marked = docs.select(F.col(id_column).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    training = texts(marked.where("NOT held_out"))
    counts = cut_lineage(unigrams(training))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(KEEP_WORDS)
    known = {bytes(r.word): r.n for r in frequent.toLocalIterator()}  # in bounds: KEEP_WORDS of WORD_BYTES
    buckets, power = build_filter(training, counts, total, model)
    scored = _scored(marked, buckets, power, spark.sparkContext.broadcast(known), total + distinct + 1, model)
    first = F.col("place").isNull() | (F.col("place") == 0)
    spread = scored.select("row", "id", "held_out", "n_tokens", "seen", "base", "score", F.posexplode_outer(F.arrays_zip("rare", "times")).alias("place", "own"))
    spread = spread.select(
        "row",
        F.coalesce("own.rare", F.encode(F.concat(F.lit("   "), F.col("row").cast("string")), "utf-8")).alias("word"),  # spread, not one null key
        F.col("own.times").alias("times"),
        *(F.when(first, F.col(c)).alias(c) for c in ("id", "held_out", "n_tokens", "seen", "base", "score")),
    )
    joined = spread.join(counts, "word", "left")
    summed = joined.groupBy("row").agg(
        F.max("id").alias(id_column),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("seen") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.max("base") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times") * F.log10(F.col("n") + 1))), F.lit(0.0))).alias("base_score"),
        F.max("score").alias("score"),
    )
    return summed.drop("row")
