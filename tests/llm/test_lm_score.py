import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import lm_score
from quern.llm.common import crc_bucket
from tests.llm.data import AWKWARD, docs


def plain(rows):
    """Base scores by brute force."""
    token = lambda t: [w.decode() for w in lm_score.tokens_of(t or "")] + [None]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out_of(i) for w in token(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        words = token(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        yield i, out_of(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)


def scored(frame):
    return lm_score.score_texts(frame, crc_bucket(F.col("doc_id"), 7) == 2)


def check(got, rows):
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_base_scores_of_awkward_rows(spark, monkeypatch):
    check(scored(docs(spark, AWKWARD)).collect(), AWKWARD)
    monkeypatch.setattr(lm_score, "KEEP_WORDS", 2)  # most words go by the join
    check(scored(docs(spark, AWKWARD)).collect(), AWKWARD)


def test_no_rows_and_no_training_rows(spark):
    assert scored(docs(spark, [])).collect() == []
    rows = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = scored(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def test_query_and_that_likely_texts_score_higher(spark, sf):
    from quern.llm.queries import op9_lm_score

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_lm_score(spark, sf).collect()
    check(got, rows)
    train = [r.score / r.n_tokens for r in got if not r.held_out]
    assert np.mean(train) > np.mean([r.base_score / r.n_tokens for r in got if not r.held_out])


def loaded(spark, training, tokens, model):
    counts = lm_score.unigrams(training)
    buckets, power = lm_score.build_filter(training, counts, tokens, model)
    return counts, lm_score.load_filter(buckets, power, 0, 1 << power)


def test_counts_are_read_back_at_their_level(spark):
    rows = [(i, "a b c " * (1 + i % 50)) for i in range(100)]
    counts, grams = loaded(spark, docs(spark, rows).select("text"), 100_000, lm_score.Model(bits=12))
    exact = {bytes(r.word): r.n for r in counts.collect()}
    levels = grams.levels(lm_score.word_hashes(list(exact)))
    assert (levels >= lm_score.levels_of(np.array(list(exact.values())))).all()
    assert (levels <= lm_score.levels_of(np.array(list(exact.values()))) + 1).all()


def test_false_positives_do_not_depend_on_the_size(spark):
    """The share of unseen words that are read as seen, at 2,000, 20,000 and 100,000 distinct words."""
    for words in (2_000, 20_000, 100_000):
        rows = [(i, " ".join(f"w{words}x{j}" for j in range(i, words, 40))) for i in range(40)]
        _, grams = loaded(spark, docs(spark, rows).select("text"), words, lm_score.Model())
        unseen = grams.levels(lm_score.word_hashes([f"unseen{i}".encode() for i in range(20_000)]))
        assert 0.02 < (unseen > 0).mean() < 0.1


def exact_scores(rows, order, weight):
    """Scores by brute force from exact counts, each at the middle of its level; START comes before a text."""
    token = lambda t: [w.decode() for w in lm_score.tokens_of(t or "")] + [None]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, first = Counter(), "\0"
    for i, t in rows:
        if not out_of(i):
            words = token(t)
            for k in range(1, order + 1):
                padded = [first] * (k - 1) + words
                counts.update(tuple(padded[j : j + k]) for j in range(len(words)))
    total = sum(n for g, n in counts.items() if len(g) == 1)
    scale = total + sum(len(g) == 1 for g in counts) + 1
    read = lambda g: 1.5 * 2 ** math.floor(math.log2(counts[g])) - 0.5 if counts[g] else 0.0
    for i, t in rows:
        words = [first] * (order - 1) + token(t)
        score = 0.0
        for j in range(order - 1, len(words)):
            p = (read((words[j],)) + 1) / scale
            for k in range(2, order + 1):
                gram = tuple(words[j - k + 1 : j + 1])
                context = read((None,)) if set(gram[:-1]) == {first} or gram[:-1][-1] == first else read(gram[:-1])
                p = (read(gram) + weight * p) / (max(context, read(gram)) + weight)
            score += math.log10(p)
        yield i, round(score, 6)


def test_scores_are_those_of_exact_counts_in_any_number_of_passes(spark, sf):
    """With bits enough that nothing is a false positive; broadcast whole, and in many ranges."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + AWKWARD
    for order, most in ((2, 1 << 30), (2, 3 << 20), (3, 6 << 20)):
        model = lm_score.Model(bits=1024, most_bytes=most, order=order)
        got = lm_score.score_texts(docs(spark, rows), crc_bucket(F.col("doc_id"), 7) == 2, model).collect()
        assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == sorted(exact_scores(rows, order, model.weight), key=str)


def test_passes_add_up_to_one_filter(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    held = crc_bucket(F.col("doc_id"), 7) == 2
    one, many = (sorted((r.doc_id, round(r.score, 9)) for r in lm_score.score_texts(frame, held, lm_score.Model(most_bytes=m)).collect()) for m in (1 << 30, 20_000))
    assert one == many


def test_held_out_texts_are_likelier_by_the_model_than_by_the_base(spark):
    from quern.llm.queries import op9_lm_score

    got = op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > sum(r.base_score for r in got)
