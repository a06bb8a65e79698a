"""A training corpus from raw documents: low quality, toxic, repeated and benchmark-holding documents go,
what is left is encoded. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, quality_rules, simhash_dedup, toxicity_knn
from quern.llm.common import crc_bucket, fresh_folder, prepare, relieve_executors, table
from quern.llm.queries import digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    usable = crc_bucket(F.col("doc_id"), 4) != 2
    sample = quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", usable, quality_rules.SAMPLE)
    return quality_rules.keep_good(docs, quality_rules.fit(sample))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity_knn.fit(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5) != 0)
    return toxicity_knn.keep_clean(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def relieved(stage: Stage) -> Stage:
    """The stage, begun with the executors' garbage of earlier ones collected."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieve_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", relieved(quality)),
    ("toxicity", relieved(toxicity)),
    ("simhash_dedup", relieved(near_duplicates)),
    ("decontamination", relieved(decontamination)),
    ("byte_bpe", relieved(encoding)),
]

#: Classifiers, fingerprints and encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
