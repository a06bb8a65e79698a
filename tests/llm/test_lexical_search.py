import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import lexical_search
from tests.llm.data import docs


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, queries, k):
    held = [(i, Counter(terms_of(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2],) if x[2] is not None else (0,)))[:k], 1)]
    return sorted(out, key=str)


WORDS = ["rain", "Sun", "town", "the", "THE", "é", "日本", "x1", "of", "river", "old", "z" * 80, "q" * 200]


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 60), p=rng.dirichlet(np.ones(len(WORDS)) * 0.4)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "!?, -"), (n + 3, "rain " * 3000), (5, rows[5 % n][1]), (n + 4, rows[7 % n][1]), (None, "rain on the old river")]


QUERIES = [(1, "Rain of the river"), (2, "sun SUN sun"), (3, None), (4, ""), (5, "nothing-like-it"), (6, "z" * 80 + ", " + "q" * 200), (7, "日本 é x1"), (8, "the the the the"), (None, "old town")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, rank int")


def test_results_are_those_of_scoring_everything(spark):
    rows = corpus(400)
    for k in (1, 5, 20, 1000):
        got = lexical_search.rank_documents(docs(spark, rows), items(spark, QUERIES), k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, QUERIES, k)


def test_small_segments_and_parts_give_the_same(spark):
    rows = corpus(300, 9)
    index = lexical_search.build(docs(spark, rows).repartition(30), segment_words=200)
    assert spark.read.parquet(index.path).count() > 10
    got = lexical_search.search(index, items(spark, QUERIES), 7, part_bytes=30)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, QUERIES, 7)


def test_many_short_documents_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 7)
    rows = corpus(50)
    total = (sum(1 for _, t in rows if terms_of(t)), sum(len(terms_of(t)) for _, t in rows))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t or "" for _, t in rows])], names=["id", "text"])
    made = list(lexical_search._segments(*total, 10**9)(iter([batch, batch])))
    held = [lexical_search.Segment.of(b, 0) for b in made]
    assert all(len(s.docs) <= 7 and len(s.n) == len(s.docs) for s in held)
    assert sum(len(s.docs) for s in held) == 2 * total[0] and sum(int(s.n.sum()) for s in held) == 2 * total[1]


def test_bounds_hold_and_leave_few_documents_to_score():
    """At the registered k, the bytes' bounds enclose each exact score and all but a few documents go unscored."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 80, p=1 / np.arange(1, 2001) / np.sum(1 / np.arange(1, 2001)))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["id", "text"])
    [made] = list(lexical_search._segments(3000, 240_000, 10**9)(iter([batch])))
    segment = lexical_search.Segment.of(made, 0)
    exact = lexical_search.impact(segment.tf.astype(np.int64), segment.n[segment.ordinals], 3000, 240_000)
    high = segment.impacts.astype(np.int64) * lexical_search.STEP
    assert np.all(exact <= high) and np.all(exact > high - lexical_search.STEP)
    terms, own = lexical_search.query_terms([(i, texts[i]) for i in range(40)])
    places = segment.places(terms)
    scored = [segment.best(places[a], np.full(len(a), 5000) * n, 20, 3000, 240_000)[2] for a, n in own]
    assert max(scored) < 200


def test_empty_tables(spark):
    assert lexical_search.rank_documents(docs(spark, []), items(spark, QUERIES)).collect() == []
    assert lexical_search.rank_documents(docs(spark, [(1, None)]), items(spark, QUERIES)).collect() == []
    assert lexical_search.rank_documents(docs(spark, corpus(5)), items(spark, [])).collect() == []


def test_very_long_texts(spark):
    rows = [(1, "rain " * 300_000), (2, "x" * 1_500_000 + " rain"), (3, "\n".join(f"line{i}" for i in range(200_000))), (4, "sun and rain")]
    queries = [(1, "rain"), (2, "x" * 1_500_000), (3, "line77 line199999 sun")]
    got = lexical_search.rank_documents(docs(spark, rows), items(spark, queries))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, queries, 20)
