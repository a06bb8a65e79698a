"""Text quality by a sparse ensemble of rules over text statistics.

Statistics are built-in column expressions. Shallow trees are grown on a bounded sample of labelled
rows; every path from a root is a conjunction of tests on statistics, a rule. A logistic regression
with an L1 penalty weighs the rules, most of them with zero, and the remaining rules are compiled into
one column expression: scoring runs within Spark's generated code.

The sample is the labelled rows of the smallest hashes of their ids, at most SAMPLE; all texts are
scored. Labels, language, source and id never enter the statistics.

Defined results: a null text is empty and has zero for all statistics; with no labelled rows, or of
one class only, every score is the smoothed share of good ones; rows with several labels train with
each; repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import collect_garbage, cut_lineage, texts

#: Labelled rows that the trees and weights are fitted on, at most.
SAMPLE = 8_000
TREES, DEPTH, PENALTY = 16, 3, 0.0005

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SYMBOLS = "#$%&*|~^<>{}[]_=+@\\"

Test = tuple[str, str, float]


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of tests (statistic, <= or >, threshold)."""

    intercept: float
    weights: tuple[tuple[tuple[Test, ...], float], ...]


def statistics(frame: DataFrame) -> DataFrame:
    """``frame`` with the statistics of its column text instead of the text; see STATISTICS."""
    kept = [c for c in frame.columns if c != "text"]
    classes = F.translate("text", UPPER + DIGITS + SYMBOLS, "A" * len(UPPER) + "0" * len(DIGITS) + "#" * len(SYMBOLS))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    first = frame.select(*kept, "text", F.length("text").alias("chars"), classes.alias("classes"), words.alias("word_list"), lines.alias("line_list"))
    second = first.select(*kept, "text", "classes", "chars", "word_list", F.size("word_list").alias("words"), F.size("line_list").alias("lines"), F.size(F.array_distinct("line_list")).alias("distinct_lines"))
    count = lambda column, mark: F.col("chars") - F.length(F.replace(F.col(column), F.lit(mark), F.lit("")))
    share = lambda part, whole: F.coalesce(F.try_divide(part, F.col(whole)), F.lit(0.0)).cast("double")
    same = F.zip_with("word_list", F.slice("word_list", 2, F.greatest(F.col("words"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return second.select(
        *kept,
        F.col("chars").cast("double").alias("chars"),
        F.col("words").cast("double").alias("words"),
        share(F.col("chars"), "words").alias("chars_a_word"),
        share(F.size(F.array_distinct("word_list")), "words").alias("distinct_words"),
        share(F.size(F.filter(same, lambda x: x)), "words").alias("repeated_words"),
        share(count("classes", "A"), "chars").alias("capitals"),
        share(count("classes", "0"), "chars").alias("digits"),
        share(count("classes", "#"), "chars").alias("symbols"),
        share(count("text", "|"), "chars").alias("bars"),
        share(count("text", "!"), "chars").alias("exclamations"),
        share(count("text", "."), "words").alias("sentences"),
        share(F.col("lines") - F.col("distinct_lines"), "lines").alias("repeated_lines"),
    )


STATISTICS = ("chars", "words", "chars_a_word", "distinct_words", "repeated_words", "capitals", "digits", "symbols", "bars", "exclamations", "sentences", "repeated_lines")


def tree_paths(described: str) -> list[tuple[Test, ...]]:
    """The conjunctions on the way to each node of the described trees, shorter ones first."""
    found: set[tuple[Test, ...]] = set()
    path: list[Test] = []
    top = None
    for line in described.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            top = len(m[1]) if top is None else top
            del path[len(m[1]) - top :]
            path.append((STATISTICS[int(m[2])], m[3], float(m[4])))
            found.add(tuple(sorted(path)))
        elif line.lstrip().startswith("Tree "):
            path, top = [], None
    return sorted(found, key=lambda r: (len(r), r))


def holds(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for name, sign, limit in rule:
        out = out & (F.col(name) <= limit if sign == "<=" else F.col(name) > limit)
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Rules:
    """Rules from (text, label 0 or 1), of which at most ``sample`` rows are used: the caller bounds them."""
    measured = cut_lineage(statistics(labelled.select("text", F.col("label").cast("double").alias("label"))).limit(sample).coalesce(2))
    good, rows = measured.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    share = (good + 1) / (rows + 2)
    prior = _logit(share)
    if good in (0, rows):
        return Rules(prior, ())
    vectors = measured.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed).fit(vectors)
    paths = tree_paths(forest.toDebugString)
    if not paths:
        return Rules(prior, ())
    rules = cut_lineage(measured.select("label", array_to_vector(F.array(*(F.when(holds(r), 1.0).otherwise(0.0) for r in paths))).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(rules)
    collect_garbage(labelled.sparkSession)  # of the jobs of both fits
    weighed = tuple((r, float(w)) for r, w in zip(paths, lasso.coefficients.toArray()) if abs(w) > 1e-6)
    return Rules(float(lasso.intercept), weighed)


def _logit(share: float) -> float:
    import math

    return math.log(share / (1 - share))


def compiled(rules: Rules) -> Column:
    """The score between 0 and 1, over the statistics."""
    total = F.lit(rules.intercept)
    for rule, weight in rules.weights:
        total = total + F.when(holds(rule), weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents: those of the smallest hashes of their ids."""
    marks = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return texts(docs, "doc_id").join(chosen, "doc_id").select("doc_id", "text", "label")


def score_quality(docs: DataFrame, rules: Rules, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted): predicted is 1 if the score reaches the threshold."""
    scored = statistics(texts(docs, "doc_id")).select("doc_id", compiled(rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, rules: Rules, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return statistics(whole).where(compiled(rules) >= threshold).select("row.*")
