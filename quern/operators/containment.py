"""Which of many patterns each text contains, as substrings, without comparing every text with every pattern.

Patterns go in parts of PART_BYTES (a longer one is a part by itself) into an automaton that reads a text once,
whatever the number of patterns (Aho and Corasick); each part is one pass over the texts. Only what is found
becomes rows: one for each text and different pattern in it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton, which takes some forty times as much memory, and rows found that are sent on together.
PART_BYTES, FOUND_ROWS = 2 << 20, 50_000


@lru_cache(maxsize=1)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, pattern in enumerate(patterns):
        automaton.add_word(pattern, number)
    automaton.make_automaton()
    return automaton


def parts_of(patterns: DataFrame, most: int) -> Iterator[tuple[str, ...]]:
    """The values of the one column in lists of about ``most`` bytes."""
    part, size = [], 0
    for (pattern,) in patterns.toLocalIterator():
        if part and size + len(pattern.encode()) > most:
            yield tuple(part)
            part, size = [], 0
        part.append(pattern)
        size += len(pattern.encode())
    if part:
        yield tuple(part)


def containments(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, pattern): each different pattern that a text contains, once for each row of ``texts``. Null and empty
    patterns and null texts match nothing; letters count as they are written."""
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{pattern}` string"
    distinct = patterns.where(F.col(pattern) != "").select(pattern).distinct()
    found = []
    for part in parts_of(distinct, part_bytes):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(shared.value), shared.value
            for batch in batches:
                rows, hits = [], []
                for row, value in enumerate(batch[1].to_pylist()):
                    own = {number for _, number in automaton.iter(value)}
                    rows += [row] * len(own)
                    hits += [names[number] for number in sorted(own)]
                    if len(rows) >= FOUND_ROWS:
                        yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), pa.array(hits, pa.string())], names=[key, pattern])
                        rows, hits = [], []
                yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=[key, pattern])

        found.append(texts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def longest_contained(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pattern): the longest pattern that each text contains, of equally long ones the least; texts without
    one have no row. Keys should be unique."""
    hits = containments(texts, patterns, key, text, pattern)
    longest = F.min(F.struct(-F.length(pattern), F.col(pattern)))
    return hits.groupBy(key).agg(longest.alias("best")).select(key, F.col(f"best.{pattern}").alias(pattern))


def best_links(events: DataFrame, notices: DataFrame, least: int = 2) -> DataFrame:
    """(event_id, notice_id, score) from events (event_id, kind, title, dates array<string>) and notices (notice_id, kind,
    text): two points for a title that the text contains, one for any of the dates, one for the same kind; the best notice
    of at least ``least`` points, of equal ones that of the smallest id. An event without one has no row.

    Titles and dates are looked for in one go. What is kept of the texts a title stands in is one for each kind, so
    a common title never meets all its texts for every event: only where a text has a date as well are pairs formed."""
    if least < 2:
        raise ValueError("a kind alone is no link: at least 2 points are needed")
    wanted = events.select("event_id", F.col("kind").alias("own_kind"), F.nullif("title", F.lit("")).alias("title"), F.array_distinct(F.filter("dates", lambda d: d != "")).alias("dates"))
    dated = wanted.select("event_id", "own_kind", "title", F.explode("dates").alias("pattern"))
    patterns = wanted.select(F.col("title").alias("pattern")).unionByName(dated.select("pattern"))
    kinds = notices.select(F.col("notice_id").alias("of"), "kind")
    # read four times below; what a lost executor held is found again
    hits = containments(notices, patterns, "notice_id", "text", "pattern").join(kinds, F.col("notice_id") == F.col("of")).drop("of").persist(StorageLevel.DISK_ONLY)
    # a title alone: the first text of each kind, of which an event's own counts one more
    first = hits.groupBy("pattern", "kind").agg(F.min("notice_id").alias("notice_id"))
    same = lambda: F.coalesce((F.col("kind") == F.col("own_kind")).cast("int"), F.lit(0))
    by_title = wanted.join(first, F.col("title") == F.col("pattern")).select("event_id", "notice_id", (2 + same()).alias("score"))
    by_date = dated.join(first, "pattern").where(same() == 1).select("event_id", "notice_id", F.lit(2).alias("score"))
    titled = hits.select(F.col("pattern").alias("title"), F.col("notice_id").alias("titled_id"))
    pairs = dated.where(F.col("title").isNotNull()).join(hits, "pattern").select("event_id", "own_kind", "title", "kind", "notice_id").distinct()
    by_both = pairs.join(titled, (F.col("notice_id") == F.col("titled_id")) & pairs["title"].eqNullSafe(titled["title"]), "left_semi").select("event_id", "notice_id", (3 + same()).alias("score"))
    every = by_title.unionByName(by_date).unionByName(by_both).where(F.col("score") >= least)
    best = every.groupBy("event_id").agg(F.max_by(F.struct("notice_id", "score"), F.struct(F.col("score"), -F.col("notice_id"))).alias("best"))
    return best.select("event_id", "best.notice_id", "best.score")
