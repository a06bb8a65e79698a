"""Every registered query against its SQL on the same tables; those without SQL run and keep their columns."""

import math

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf, database, name):
    found = QUERIES[name](spark, sf)
    want = database.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert all(len(r) == len(found.columns) for r in found.collect())


@pytest.mark.parametrize("name", ["stratified_split", "keep_best_per_key", "hybrid_merge", "quota_sample", "fuzzy_best_match", "ocr_grid"])
def test_rows_do_not_depend_on_the_partitions(spark, sf, name):
    first = rows_of(QUERIES[name](spark, sf).columns, [tuple(r) for r in QUERIES[name](spark, sf).collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = QUERIES[name](spark, sf)
        assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_runs(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 10
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_benchmark_overlap_counts_the_documents_words_once(spark, sf):
    from quern.queries.text import benchmark_overlap

    # what is left to read are the stored counts
    assert not [f for f in benchmark_overlap(spark, sf).inputFiles() if "documents" in f]
