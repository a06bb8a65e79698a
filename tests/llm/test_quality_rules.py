import math

import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules
from quern.llm.common import crc_bucket
from tests.llm.data import AWKWARD, docs


def auc(rows, score, label):
    good = [r[score] for r in rows if r[label] == 1]
    bad = [r[score] for r in rows if r[label] == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    from quern.llm.queries import op7_quality

    sf = "/root/testdata/sf0.01"
    got = op7_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc(rows, "score", "quality") > 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_statistics_of_awkward_rows(spark):
    got = {r.doc_id: r for r in quality_rules.statistics(docs(spark, AWKWARD).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    assert all(math.isfinite(v) for r in got.values() for k, v in r.asDict().items() if k != "doc_id")
    assert (got[1].chars, got[1].words, got[1].repeated_words, got[4].words) == (0, 0, 0, 0)
    assert got[6].chars == 5000 and got[6].words == 1
    (row,) = quality_rules.statistics(docs(spark, [(1, "A A b|1!\n\nA A b|1!")]).select("doc_id", "text")).collect()
    assert (row.words, row.repeated_words, row.repeated_lines) == (6, 2 / 6, 0.5)
    assert (row.capitals, row.digits, row.symbols, row.exclamations) == pytest.approx((4 / 18, 2 / 18, 2 / 18, 2 / 18))


def test_rules_are_paths_of_the_trees_and_compile_to_their_sum(spark):
    described = "x\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.0)\n     If (feature 1 <= 1.0)\n      Predict: 0.0\n     Else (feature 1 > 1.0)\n      Predict: 1.0\n    Else (feature 0 > 2.0)\n     Predict: 1.0\n"
    paths = quality_rules.tree_paths(described)
    low, high = ("chars", "<=", 2.0), ("chars", ">", 2.0)
    assert paths == [(low,), (high,), (low, ("words", "<=", 1.0)), (low, ("words", ">", 1.0))]
    rules = quality_rules.Rules(0.5, ((paths[1], 2.0), (paths[3], -1.0)))
    frame = spark.createDataFrame([(3.0, 0.0), (1.0, 2.0), (1.0, 0.0)], "chars double, words double")
    got = [r[0] for r in frame.select(quality_rules.compiled(rules)).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in (2.5, -0.5, 0.5)])


def test_no_labels_one_class_and_no_rows(spark):
    frame = docs(spark, AWKWARD)
    labels = spark.createDataFrame([(5, 1), (6, 1), (5, None), (None, 0)], "doc_id long, quality int")
    sample = quality_rules.labelled_sample(frame, labels, "quality", crc_bucket(F.col("doc_id"), 1) == 0, 10)
    rules = quality_rules.fit(sample)
    assert rules.weights == ()
    assert {round(r.score, 6) for r in quality_rules.score_quality(frame, rules).collect()} == {0.75}
    none = quality_rules.fit(sample.where("false"))
    assert {r.score for r in quality_rules.score_quality(frame, none).collect()} == {0.5}
    assert quality_rules.score_quality(docs(spark, []), none).collect() == []
