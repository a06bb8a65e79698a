"""An import in stages: items are excluded, found again or new; what is read from the new ones is checked, and
merged by key with each other and with what is stored.

Arrival decides as it would one item after the other: of items of one content the first is new, of candidates of
one key the first makes an event and the others join it. Since a join changes no key, the order needs no loop: it is a
minimum a key. No stage holds the items of a content or a key in one place but for distinct titles of a key, which differ
in case and punctuation only, and its last candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.rules import first_rule
from quern.operators.partitions import stored as computed_once

#: Candidates that an event remembers.
REMEMBERED = 20


def key_of(*columns: Column | str) -> Column:
    """One text for several columns, null apart from empty."""
    return F.md5(F.to_json(F.struct(*(F.col(c) if isinstance(c, str) else c for c in columns)), {"ignoreNullFields": "false"}))


def item_outcomes(items: DataFrame, excluded: Column, stored: DataFrame, item: str = "item_id", content: str = "content") -> DataFrame:
    """``items`` with outcome: ``excluded: <reason>`` where the reason is not null, ``stored`` for a content that ``stored`` has,
    ``repeated`` for one of an earlier item that is not excluded, else ``new``; and first_item, the earliest of the content."""
    marked = items.withColumn("_reason", excluded)
    firsts = marked.where("_reason IS NULL").groupBy(content).agg(F.min(item).alias("first_item"))
    known = stored.select(content).distinct().withColumn("_known", F.lit(True))
    joined = marked.join(firsts.join(known, content, "left"), content, "left")
    outcome = first_rule([(F.col("_reason").isNotNull(), F.concat(F.lit("excluded: "), F.col("_reason"))), (F.col("_known"), F.lit("stored")), (F.col(item) != F.col("first_item"), F.lit("repeated"))], F.lit("new"))
    return joined.withColumn("outcome", outcome).drop("_reason", "_known")


def merge_candidates(candidates: DataFrame, events: DataFrame, order: Sequence[str], remembered: int = REMEMBERED) -> DataFrame:
    """(key, event_id, title, aliases, merged, n_candidates, change) of each key of ``candidates`` (key, title, candidate and the columns of
    ``order``, which no two rows share).

    ``events`` has (key, event_id, title, aliases, merged); of several of one key the one of the smallest id takes the candidates.
    title is the shortest, then least, of all titles and aliases; aliases are the others in order. merged holds the last
    ``remembered`` candidates, the stored ones before the new ones, without the candidate that makes a new event.
    A key that no event has is an ``insert``, with a null event_id; a null or empty title names nothing."""
    candidates = computed_once(candidates.select("key", "title", "candidate", *order))  # read three times, and dear to make
    stored = events.groupBy("key").agg(F.min_by(F.struct("event_id", "title", "aliases", "merged"), "event_id").alias("e"))
    named = candidates.where("title <> ''").select("key", "title").distinct()
    counts = candidates.groupBy("key").agg(F.count("*").alias("n_candidates"))
    titles = named.groupBy("key").agg(F.collect_list("title").alias("titles"))
    # the last ones of a key: Spark cuts each partition to as many before the shuffle
    place = F.row_number().over(W.partitionBy("key").orderBy(*(F.desc(c) for c in order)))
    late = candidates.select("key", "candidate", *order).withColumn("_place", place).where(F.col("_place") <= remembered)
    last = late.groupBy("key").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("_place", "candidate"))), lambda x: x["candidate"])).alias("last"))
    joined = counts.join(last, "key").join(titles, "key", "left").join(stored, "key", "left")
    insert = F.col("e").isNull()
    none = F.array().cast("array<string>")
    # the maker of a new event is among the last ones only where all of them are
    added = F.when(insert & (F.col("n_candidates") <= remembered), F.slice("last", F.lit(2), F.lit(remembered))).otherwise(F.col("last"))
    every = F.concat(F.coalesce("e.merged", none), added)
    tail = F.when(F.size(every) > remembered, F.slice(every, -remembered, remembered)).otherwise(every)
    known = F.filter(F.concat(F.coalesce("titles", none), F.coalesce("e.aliases", none), F.array("e.title")), lambda t: t.isNotNull() & (t != ""))
    ranked = F.array_sort(F.transform(F.array_distinct(known), lambda t: F.struct(F.length(t).alias("n"), t.alias("title"))))
    best = F.coalesce(F.try_element_at("_ranked", F.lit(1)).getField("title"), F.lit(""))
    out = joined.withColumn("_ranked", ranked).withColumn("_tail", tail)
    others = F.array_sort(F.transform(F.slice("_ranked", F.lit(2), F.greatest(F.size("_ranked"), F.lit(1))), lambda x: x["title"]))
    return out.select("key", "e.event_id", best.alias("title"), others.alias("aliases"), F.col("_tail").alias("merged"), "n_candidates", F.when(insert, "insert").otherwise("merge").alias("change"))


def first_in_order(rows: DataFrame, key: Sequence[Column], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in an order that no two rows share; nulls are equal and come first."""
    names = rows.columns
    own = rows.withColumn("_key", key_of(*(k.alias(f"k{i}") for i, k in enumerate(key))))
    return own.groupBy("_key").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")
