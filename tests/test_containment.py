import random

import pytest

from quern.operators import containment


def corpus(n, seed=5):
    rng = random.Random(seed)
    parts = ["rain", "ain", "on", "the", "é", "日本", "2024.1.2", "1.2", " ", "x" * 50]
    return [(i, rng.choice("ab"), None if i % 17 == 0 else "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("part_bytes", [1, 40, 1 << 20])
def test_containments_are_those_of_brute_force(spark, part_bytes):
    texts = corpus(120)
    patterns = ["rain", "ain", "rain on", "é日本", "zz", "", None, "rain", "1.2", "x" * 50, "nt", "\n"]
    got = containment.containments(
        spark.createDataFrame(texts, "id long, pattern string, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), "id", "text", "pattern", part_bytes
    ).collect()
    want = [(i, p) for i, _, t in texts if t is not None for p in sorted({p for p in patterns if p}) if p in t]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_no_patterns_and_no_texts(spark):
    texts, none = spark.createDataFrame(corpus(5), "id long, kind string, text string"), spark.createDataFrame([], "p string")
    assert containment.containments(texts, none, "id", "text", "p").collect() == []
    assert containment.containments(texts.limit(0), spark.createDataFrame([("a",)], "p string"), "id", "text", "p").collect() == []


def test_longest_of_equally_long_ones_the_least(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "cdab"), (3, "x"), (4, None)], "id long, text string")
    patterns = spark.createDataFrame([(p,) for p in ("ab", "cd", "bcd", "cde", "")], "p string")
    assert sorted(map(tuple, containment.longest_contained(texts, patterns, "id", "text", "p").collect())) == [(1, "bcd"), (2, "ab")]


def test_links_are_those_of_scoring_every_pair(spark):
    rng = random.Random(8)
    notices = corpus(200)
    titles = ["rain", "rain on", "the é", "日本", "nowhere", "", None]
    events = [(i, rng.choice(["a", "b", None]), rng.choice(titles), rng.choice([["2024.1.2", "1.2"], ["9.9"], [], ["1.2", ""], None])) for i in range(60)]
    got = containment.best_links(spark.createDataFrame(events, "event_id long, kind string, title string, dates array<string>"), spark.createDataFrame(notices, "notice_id long, kind string, text string"))
    want = []
    for i, kind, title, dates in events:
        scored = []
        for n, own, text in notices:
            if text is not None:
                score = 2 * bool(title and title in text) + any(d and d in text for d in dates or []) + (kind == own)
                scored += [(-score, n)] if score >= 2 else []
        want += [(i, min(scored)[1], -min(scored)[0])] if scored else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[2] for w in want} == {2, 3, 4}


def test_a_very_long_text_is_read_once(spark):
    texts = spark.createDataFrame([(1, "ab" * 1_000_000 + "needle")], "id long, text string")
    patterns = spark.createDataFrame([("ab" * 500,), ("needle",), ("needles",)], "p string")
    assert len(containment.containments(texts, patterns, "id", "text", "p").collect()) == 2
