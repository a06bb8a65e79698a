import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.operators import bags
from quern.queries.text import ORACLES, benchmark_overlap

WORDS = [f"w{i}" for i in range(40)] + ["é", "日本"]


def corpus(n, most, seed):
    rng = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    return [None if i % 23 == 22 else rng.choices(WORDS, weights, k=rng.randint(0, most)) for i in range(n)]


def brute_force(documents, items, least):
    def of(rows):
        found = {}
        for key, words in rows:
            found.setdefault(key, Counter()).update(words or [])
        return found

    found, own = of(documents), {i: bag for i, bag in of(items).items() if i is not None and bag}
    first = {i: min(j for j in own if own[j] == own[i]) for i in own}
    shared = {(k, i): (d & own[i]).total() for k, d in found.items() for i in set(first.values())}
    good = {(i, n): [k for (k, j), m in shared.items() if (j, m) == (i, n) and k is not None] for (_, i), n in shared.items() if n >= least * own[i].total() - 1e-9}
    return {(min(k, default=None), i, n, own[i].total()) for (i, n), k in good.items()}, set(first.items())


# keys are all different, or in part the same
@pytest.mark.parametrize(("least", "part_words", "keys"), [(0.6, 60, 1_000), (0.6, 60, 50), (0.3, 1, 1_000), (0.3, 500_000, 50), (1.0, 500_000, 1_000)])
def test_first_sharers_are_those_of_every_pair(spark, least, part_words, keys):
    documents = [(None if i == 5 or keys == 50 and i == 70 else i % keys, words) for i, words in enumerate(corpus(120, 30, 1))]
    items = [(None if i == 7 else i % 30, words) for i, words in enumerate(corpus(40, 12, 2))] + [(100, ["w0", "w1", "w0"]), (99, ["w1", "w0", "w0"])]
    tables = spark.createDataFrame(documents, "id long, words array<string>").repartition(3), spark.createDataFrame(items, "item int, words array<string>")
    sharers, equal = bags.first_sharers(*tables, "id", "item", "words", least, part_words)
    got, (want, first) = list(map(tuple, sharers.select("id", "item", "shared", "total").collect())), brute_force(documents, items, least)
    assert len(got) == len(want) > 0 and set(got) == want
    assert set(map(tuple, equal.select("item", "first").collect())) == first and (100, 99) in first


def test_no_documents_and_no_items(spark):
    kinds = "id string, words array<string>", "item string, words array<string>"
    rows = [[("a", ["x"])], [("b", [])], []]
    for documents, items in [(rows[0], rows[2]), (rows[0], rows[1]), (rows[2], rows[0]), (rows[1], rows[0])]:
        sharers, _ = bags.first_sharers(spark.createDataFrame(documents, kinds[0]), spark.createDataFrame(items, kinds[1]), "id", "item", "words", 0.6)
        assert sharers.collect() == []


def test_steps_of_any_size_find_the_same():
    part = bags._bags([3, 1, 2], [[("w0", 2), ("w1", 1)], [("w1", 1), ("w2", 3), ("w3", 1)], [("w0", 1)]], pa.int64())
    documents = corpus(60, 8, 3)
    lengths, words = np.array([len(d or []) for d in documents]), pa.array([w for d in documents for w in d or []], pa.string())
    found = [sorted(tuple(map(int, row)) for step in bags.held(part, lengths, words, None, 0.6, most) for row in zip(*step)) for most in (1, 7, 1_000_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 5


def test_benchmark_overlap_is_its_sql_on_odd_tables(spark, tmp_path):
    text = lambda words: None if words is None else " ".join(words)
    own = [(None if i % 50 == 49 else i % 90, text(words)) for i, words in enumerate(corpus(120, 40, 4))] + [(500, ""), (None, "only here, in both"), (501, "in both of these")]
    asked = [(i % 20, text(words)) for i, words in enumerate(corpus(30, 10, 5))] + [(None, "w0"), (70, "W0, w1"), (71, "w1 w0"), (72, "..."), (80, "Only here."), (81, "in both of these only here")]
    connection = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", own), ("benchmark", "item_id", asked)):
        pq.write_table(pa.table({key: pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / f"{name}.parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = benchmark_overlap(spark, str(tmp_path)).select("item_id", "share", "doc_id").collect()
    want = connection.execute(f"SELECT item_id, share, doc_id FROM ({ORACLES['benchmark_overlap']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 10 and (80, 1.0, None) in want


def test_benchmark_overlap_writes_no_row_for_each_word_of_a_pair(spark, tmp_path):
    # every document shares words with every item, but few hold 60 per cent
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    for name, key, n, size in (("documents", "doc_id", 1_500, 20), ("benchmark", "item_id", 60, 30)):
        rows = [" ".join(rng.sample(words, size)) for _ in range(n)]
        pq.write_table(pa.table({key: list(range(n)), "text": rows}), tmp_path / f"{name}.parquet")
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        every = context.statusStore().executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = written()
    benchmark_overlap(spark, str(tmp_path)).collect()
    assert written() - before < (tmp_path / "documents.parquet").stat().st_size
