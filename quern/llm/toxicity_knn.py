"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled documents, all of whose terms count. A term's weight in a text is
(1 + log its count there) times its inverse document frequency over all documents, times the square of its
relevance, log2(2 + a / max(1, c)) for a toxic and c other examples that have it: by inverse frequencies alone
texts are near to those of their subject and language, whatever their label. The examples' vectors form an
inverted index in blocks of 16 like examples, with the largest weight of each term in each block. What common terms
(those of one in 32 examples) add to the cosines is one matrix product for many texts. A query takes the
blocks by falling upper bound, the best of these sums and its other terms' largest weights there, and stops where no
block can reach the k-th best cosine: the neighbours are exact. Their votes weigh by nearness and are smoothed towards the examples' share, which makes the score a
probability; the neighbours' ids are the evidence.

Defined results: terms that no example has are left out of a text's vector; a text that has no other (an empty
or null one, too) scores as the examples without terms do; equal cosines at the k-th place all vote; copies of a
labelled text are one example; without toxic examples scores are small and without any examples one half; repeated
rows each give a row; other columns are ignored; an empty table gives an empty result. Labels, language, source
and id never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, prepare, relieve_executors, texts
from quern.llm.quality_rules import labelled_sample

#: Examples, and terms of all of them together and of one, at most; neighbours that vote.
EXAMPLES, POSTINGS, LONGEST, NEIGHBOURS = 3_000, 3_000_000, 50_000, 15
#: Examples of a block; blocks scored before the first look at the bounds; numbers of a hashed vector, by which like examples are found.
BLOCK, STEP, DIMENSIONS = 16, 24, 512
#: A term in one of so many examples is common, for as many numbers as make 16 MB; texts whose common terms are multiplied at once.
COMMON, DENSE, ROWS = 32, 2_000_000, 64
#: Weight of the examples' share of toxic ones against the votes; results one worker keeps.
SMOOTH, KEPT = 0.5, 100_000
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»¿¡…"

Example = tuple[int, list[str], list[int], int]


def terms_of(text: str) -> Counter:
    """Counts of lower-case words without punctuation around them."""
    found = Counter(map(str.strip, text.lower().split(), repeat(STRIP)))
    found.pop("", None)
    return found


def numbers_of(terms: Iterable[str], number: dict[str, int], size: int) -> np.ndarray:
    """The numbers of so many terms, -1 where there is none: looked up without a step of Python for each."""
    return np.fromiter(map(number.get, terms, repeat(-1)), np.int64, size)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms_of(text) for text in batch["text"].to_pylist()]
        terms, counts = pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], terms, counts], names=["doc_id", "label", "terms", "counts"])


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = shared.value, 0
        found = np.zeros(len(number), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for text in batch["text"].to_pylist():
                terms = set(map(str.strip, text.lower().split(), repeat(STRIP)))
                numbers = numbers_of(terms, number, len(terms))
                found[numbers[numbers >= 0]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], rows))], names=["term", "n"])

    return run


def document_frequencies(docs: DataFrame, terms: set[str]) -> tuple[dict[str, int], int]:
    """Documents with each term, and all documents."""
    names = sorted(terms)
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    counted = texts(docs).mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counted.toLocalIterator()}  # in bounds: POSTINGS
    documents = found.pop(-1, 0)
    return {names[i]: n for i, n in found.items()}, documents


def alike(term: np.ndarray, owner: np.ndarray, own: np.ndarray, examples: int) -> np.ndarray:
    """An order of the examples in which like ones are near: halves by the direction in which they differ most, of hashed
    vectors of DIMENSIONS, again and again down to blocks."""
    dense = np.zeros((examples, DIMENSIONS))
    mixed = term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    np.add.at(dense, (owner, (mixed % np.uint64(DIMENSIONS)).astype(np.int64)), own * np.where(mixed // np.uint64(DIMENSIONS) % np.uint64(2), 1, -1))
    done, open_ones = [], [np.arange(examples)]
    while open_ones:
        part = open_ones.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        spread = dense[part] - dense[part].mean(axis=0)
        along = spread @ np.linalg.eigh(spread.T @ spread)[1][:, -1]
        # whole blocks on one side, so that only the last one is not full
        cut = BLOCK * max(1, round(len(part) / BLOCK / 2))
        order = np.argsort(along, kind="stable")
        open_ones += [part[order[cut:]], part[order[:cut]]]
    return np.concatenate(done) if done else np.arange(0)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Index:
    """The examples' vectors by term, in blocks of like examples: a bounded number of common terms as rows of all examples; for
    each other term the blocks that have it, its largest weight there and where its postings there begin."""

    def __init__(self, examples: list[Example], frequencies: dict[str, int], documents: int) -> None:
        worded = sorted((e for e in examples if e[1]), key=lambda e: (e[0], e[3]))
        bad, blank = sum(e[3] for e in examples), [e[3] for e in examples if not e[1]]
        self.share = (bad + 0.5) / (len(examples) + 1)
        self.without = (sum(blank) + SMOOTH * self.share) / (len(blank) + SMOOTH)
        self.number: dict[str, int] = {}
        term = np.array([self.number.setdefault(t, len(self.number)) for e in worded for t in e[1]], np.int64)
        owner = np.repeat(np.arange(len(worded)), [len(e[1]) for e in worded]).astype(np.int64)
        count = np.array([n for e in worded for n in e[2]], np.float64)
        size, labels = len(self.number), np.array([e[3] for e in worded], np.int64)
        toxic = np.bincount(term, weights=labels[owner], minlength=size)
        other = np.bincount(term, minlength=size) - toxic
        idf = np.array([math.log((1 + documents) / (1 + frequencies.get(t, 0))) + 1 for t in self.number])
        self.weight = idf * np.log2(2 + toxic / np.maximum(1, other)) ** 2
        own = (1 + np.log(count)) * self.weight[term]
        own = own / np.sqrt(np.bincount(owner, weights=own**2, minlength=len(worded)))[owner]
        order = alike(term, owner, own, len(worded))
        place = np.empty(len(worded), np.int64)
        place[order] = np.arange(len(worded))
        owner, self.bad, self.ids = place[owner], labels[order], np.array([e[0] for e in worded], np.int64)[order]
        self.blocks = -(-len(worded) // BLOCK)
        # rows of the most common terms, whole blocks wide
        have = np.bincount(term, minlength=size)
        common = np.argsort(-have, kind="stable")[: DENSE // max(1, self.blocks * BLOCK)]
        common = common[have[common] * COMMON >= max(1, len(worded))]
        self.row = np.full(size, -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.common[self.row[term[dense]], owner[dense]] = own[dense]
        term, owner, own = term[~dense], owner[~dense], own[~dense]
        # postings of the others by term and block
        by = np.lexsort((owner, term))
        term, self.owner, self.own = term[by], owner[by].astype(np.int32), own[by]
        pair = term * max(1, self.blocks) + self.owner // BLOCK
        self.low = np.flatnonzero(np.diff(pair, prepend=-1))
        self.length = np.diff(self.low, append=len(pair))
        self.most = np.maximum.reduceat(self.own, self.low) if len(pair) else self.own
        self.block = (self.owner[self.low] // BLOCK).astype(np.uint16)
        self.first = np.searchsorted(term[self.low], np.arange(size + 1))

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length weights of a text."""
        terms, counts = numbers_of(found, self.number, len(found)), np.fromiter(found.values(), np.float64, len(found))
        terms, counts = terms[terms >= 0], counts[terms >= 0]
        weights = (1 + np.log(counts)) * self.weight[terms]
        return terms, weights / math.sqrt((weights**2).sum()) if len(terms) else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, base: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and cosines of the examples at least as near as the k-th nearest, none at cosine 0, and how many blocks were
        scored for it, for terms that are not common and what the common ones add to each example. A block's bound is the best
        such sum in it and the largest weights of its other terms; blocks are scored by falling bound, first STEP and then
        about twice as many each time, until no bound reaches the k-th cosine."""
        start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        pairs, factor = spans(start, size), np.repeat(weights, size)
        block = self.block[pairs]
        bound = np.bincount(block, weights=self.most[pairs] * factor, minlength=self.blocks) + base.reshape(self.blocks, BLOCK).max(axis=1)
        queue = np.argsort(-bound, kind="stable")
        queue, done = queue[: np.count_nonzero(bound > 0)], 0
        every, values, least = np.array([], np.int64), np.array([]), 0.0
        while done < len(queue):
            step = queue[done : 2 * done + STEP]
            step = step[bound[step] >= least - 1e-9]
            if not len(step):
                break
            done += len(step)
            wanted = np.zeros(self.blocks, bool)
            wanted[step] = True
            mine = np.flatnonzero(wanted[block])
            some = pairs[mine]
            length = self.length[some]
            at = spans(self.low[some], length)
            members = (step[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = np.bincount(self.owner[at], weights=self.own[at] * np.repeat(factor[mine], length), minlength=len(base))[members] + base[members]
            hit = np.flatnonzero(score > max(0.0, least - 1e-12))
            every, values = np.concatenate([every, members[hit]]), np.concatenate([values, score[hit]])
            if len(every) > k:
                least = np.partition(values, -k)[-k]
                stay = values >= least - 1e-12
                every, values = every[stay], values[stay]
        order = np.lexsort((every, -values))
        return every[order], values[order], done

    def searches(self, whole: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """What `nearest` takes, for each text; None where no example has a term of it."""
        for first in range(0, len(whole), ROWS):
            vectors = [self.vector(terms_of(text)) for text in whole[first : first + ROWS]]
            queries, rows = np.zeros((len(vectors), len(self.common))), [self.row[terms] for terms, _ in vectors]
            for query, row, (_, weights) in zip(queries, rows, vectors):
                query[row[row >= 0]] = weights[row >= 0]
            for row, (terms, weights), base in zip(rows, vectors, queries @ self.common):
                yield (terms[row < 0], weights[row < 0], base) if len(terms) else None

    def scores(self, whole: list[str]) -> list[tuple[float, list[int]]]:
        """For each text the smoothed, distance-weighted vote, and the ids of up to three of the nearest examples."""
        return [self.vote(*self.nearest(*search)[:2]) if search else (self.without, []) for search in self.searches(whole)]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int]]:
        if not len(found):
            return self.without, []
        weight = 1 / (0.05 + 1 - np.minimum(cosines, 1))
        votes = (weight * self.bad[found]).sum() + SMOOTH * self.share
        return float(votes / (weight.sum() + SMOOTH)), self.ids[found[:3]].tolist()


def scores(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[float, list[int]]]]]:
    """Each batch with the results of its texts; copies of a text are scored once a worker."""
    import xxhash

    kept: dict = {}
    for batch in batches:
        whole = [text or "" for text in batch["text"].to_pylist()]
        keys = [xxhash.xxh128_digest(text) for text in whole]
        if len(kept) >= KEPT:
            kept.clear()
        new = {key: text for key, text in zip(keys, whole) if key not in kept}
        kept.update(zip(new, index.scores(list(new.values()))))
        yield batch, [kept[key] for key in keys]


def _score(shared, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(shared.value, batches):
            yield pa.RecordBatch.from_arrays([batch[id_column], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=[id_column, "score", "evidence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = EXAMPLES) -> Index:
    """The index over at most ``most`` labelled documents that ``usable`` allows, with at most POSTINGS terms in all;
    a document of over LONGEST different terms is no example."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, usable, most).withColumn("label", F.col("label").cast("int"))
    distinct = sample.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = cut_lineage(texts(distinct, "doc_id", "label").mapInArrow(_counted, f"doc_id {kind}, label int, terms array<string>, counts array<long>"))
    so_far = F.sum(F.size("terms")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id", "label"))  # of at most ``most`` rows
    chosen = counted.where(F.size("terms") <= LONGEST).withColumn("so_far", so_far).where(F.col("so_far") <= POSTINGS)
    named: dict[str, str] = {}  # one text a term, not one a posting
    rows = [(r.doc_id, [named.setdefault(t, t) for t in r.terms], r.counts, r.label) for r in chosen.toLocalIterator()]  # in bounds: POSTINGS
    frequencies, documents = document_frequencies(docs, {t for r in rows for t in r[1]})
    relieve_executors(docs.sparkSession)
    return Index(rows, frequencies, documents)


def score_toxicity(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, evidence): predicted is 1 if the score reaches the threshold."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = texts(docs, "doc_id").mapInArrow(_score(spark.sparkContext.broadcast(index), "doc_id"), f"doc_id {kind}, score double, evidence array<long>")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def _clean(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(shared.value, batches):
            yield batch.filter(pa.array([s < threshold for s, _ in found], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold."""
    spark = prepare(docs.sparkSession)
    return docs.mapInArrow(_clean(spark.sparkContext.broadcast(index), threshold), docs.schema)
