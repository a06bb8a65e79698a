import datetime as dt
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from quern.operators import merge
from quern.streaming import ingest

SCHEMA = "id long, title string, body string, meta string"


def files(path):
    return {p.parent.name: p.name for p in Path(path).rglob("*.parquet")}


def rows_of(spark, path):
    return sorted(map(tuple, merge.stored(spark, path).select("id", "title", "body", "meta").collect()), key=str)


def test_untouched_buckets_keep_their_files_and_the_result_is_that_of_a_full_rewrite(spark, tmp_path):
    rng = random.Random(2)
    table = {i: (f"t{i % 5}" if i % 7 else None, f"body {i} [OCR] seen", json.dumps({"a": i, "b": [1, 2]})) for i in range(300)}
    path = str(tmp_path / "t")
    merge.create(spark.createDataFrame([(i, *v) for i, v in table.items()], SCHEMA), path, ["id"], 32)
    before = files(path)
    load = {
        1: table[1], 2: (table[2][0], "body 2 [OCR] other", '{ "b" : [1, 2], "a":2 }'), 3: ("new title", *table[3][1:]), 7: ("x", *table[7][1:]), 14: (None, *table[14][1:]), 1000: (None, None, None), 21: (table[21][0], None, table[21][2]), 22: (*table[22][:2], "no json"),
    }
    found = merge.merge(spark, path, spark.createDataFrame([(i, *v) for i, v in load.items()], SCHEMA), ["id"], 32, json=["meta"], marked=["body"], mark="[OCR]")
    assert {k: found[k] for k in ("insert", "update", "skip")} == {"insert": 1, "update": 4, "skip": 3}
    want = table | {i: load[i] for i in (3, 7, 21, 22, 1000)}
    assert rows_of(spark, path) == sorted([(i, *v) for i, v in want.items()], key=str)
    after = files(path)
    changed = {b for b in after if before.get(b) != after[b]}
    hit = {f"bucket={r.b}" for r in spark.createDataFrame([(i,) for i in (3, 7, 21, 22, 1000)], "id long").select(merge.bucket_of(["id"], 32).alias("b")).collect()}
    assert changed == hit and len(changed) == found["buckets"] < len(after)
    # the same load again changes nothing
    assert merge.merge(spark, path, spark.createDataFrame([(i, *v) for i, v in load.items()], SCHEMA), ["id"], 32, json=["meta"], marked=["body"], mark="[OCR]") == {"insert": 0, "update": 0, "skip": 8, "buckets": 0}
    assert files(path) == after and not list(tmp_path.glob("*merging*"))
    assert rng.random() >= 0


def test_canonical_json_and_marks(spark):
    values = ['{"b": 1, "a": {"d": 2, "c": [1, {"y": 1, "x": 2}]}}', ' {"a":{"c":[1,{"x":2,"y":1}],"d":2},"b":1} ', "broken {", None, "[2, 1]", "[1, 2]"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(merge.canonical_json(F.col("v"))).collect()]
    assert got[0] == got[1] and got[2:4] == ["broken {", None] and got[4] != got[5]
    got = spark.createDataFrame([(" a #x b",), ("a\n",), (None,), ("#x",)], "v string").select(merge.before_mark(F.col("v"), "#x")).collect()
    assert [r[0] for r in got] == ["a", "a", "", ""]


def put(path, rows):
    path.write_text("".join(json.dumps({"doc_id": i, "text": t, "version": v}) + "\n" for i, t, v in rows))


def test_a_stream_takes_a_failing_document_again_until_it_succeeds(spark, tmp_path):
    source, down = tmp_path / "in", tmp_path / "down"
    source.mkdir()
    down.touch()
    at = lambda name: str(tmp_path / name)
    ingest.new_state(spark, at("state"))
    stats = []

    def embed(chunks):
        """A service that cannot take texts with bad in them while it is down."""
        made = ingest.hashed_vectors(chunks)
        return made.withColumn("vector", F.when(~F.contains("content", F.lit("bad")), F.col("vector"))) if down.exists() else made

    def run():
        ingest.ingest_with_state(spark, str(source), at("index"), at("state"), at("checkpoint"), embed, stats).awaitTermination()
        return {r.doc_id: (r.status, r.attempts, r.chunks) for r in merge.stored(spark, at("state")).collect()}

    put(source / "a.json", [(1, "good words", "2024-01-01T00:00:00"), (2, "bad\n\n" + "long " * 300, "2024-01-01T00:00:00"), (3, None, "2024-01-01T00:00:00")])
    assert run() == {1: ("SUCCESS", 1, 1), 2: ("FAILED", 1, 0), 3: ("SUCCESS", 1, 0)}
    put(source / "b.json", [(1, "good words", "2024-02-01T00:00:00"), (4, "", "2024-01-01T00:00:00"), (3, "older", "2023-01-01T00:00:00")])
    assert run() == {1: ("SUCCESS", 1, 1), 2: ("FAILED", 2, 0), 3: ("SUCCESS", 1, 0), 4: ("SUCCESS", 1, 1)}
    down.unlink()
    put(source / "c.json", [(1, "other words", "2024-03-01T00:00:00")])
    assert run() == {1: ("SUCCESS", 1, 1), 2: ("SUCCESS", 3, 2), 3: ("SUCCESS", 1, 0), 4: ("SUCCESS", 1, 1)}
    assert stats == [{"total": 3, "success": 2, "failed": 1, "chunks": 1}, {"total": 2, "success": 1, "failed": 1, "chunks": 1}, {"total": 2, "success": 2, "failed": 0, "chunks": 3}]
    index = {r.chunk_id: r for r in ingest.current_index(spark, at("index")).collect()}
    assert index["1-0"].content == "other words" and index["2-0"].vector and set(index) == {"1-0", "2-0", "2-1", "4-0"}
    assert abs(sum(v * v for v in index["2-1"].vector.values()) - 1) < 1e-9


def test_attempts_can_be_bounded(spark, tmp_path):
    state, index = str(tmp_path / "s"), str(tmp_path / "i")
    ingest.new_state(spark, state, spark.createDataFrame([(1, "text", dt.datetime(2024, 1, 1))], ingest.DOCUMENT))
    broken = lambda chunks: chunks.withColumn("vector", F.lit(None).cast("map<int,double>"))
    assert [ingest.embed_pending(spark, state, index, n, broken, 2)["failed"] for n in range(3)] == [1, 1, 0]
