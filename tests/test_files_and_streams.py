import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import ingest


def test_json_documents_of_three_shapes(spark, tmp_path):
    for name, value in (("a", [{"t": "1"}, {"t": "2"}]), ("b", {"items": [{"t": "3"}]}), ("c", {"t": "4"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    assert sorted(r.t for r in files.json_documents(spark, str(tmp_path), "items", "t string").collect()) == ["1", "2", "3", "4"]


def test_json_lines_tolerant_and_strict(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n\n  \n{"a": oops\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in files.tolerant_json_lines(spark, str(path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.strict_json_lines(spark, str(path), "a int").collect()


def test_word_documents_and_question_lists(spark, tmp_path):
    ns = files.WORD_NAMESPACE[1:-1]
    paragraphs = ["A. Calendar", "1. When is it?", "2. And then?", "B. Rules", "1. May I?"]
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(tmp_path / "q.docx", "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    found = files.numbered_questions(files.word_documents(spark, str(tmp_path))).orderBy("section", "number").collect()
    assert [(r.section, r.number, r.question) for r in found] == [("A", 1, "When is it?"), ("A", 2, "And then?"), ("B", 1, "May I?")]


def test_tagged_records(spark):
    text = "intro\n[1] category: x\nQ: why\nnot\nA: because\n[2] category: y\nQ: how A: so\n"
    got = files.tagged_records(spark.createDataFrame([("p", text)], "path string, value string")).orderBy("number").collect()
    assert [(r.number, r.category, r.question, r.answer) for r in got] == [(1, "x", "why\nnot", "because"), (2, "y", "how", "so")]


def test_markdown_questions(spark):
    text = "# Title\n## What?\nThis.\n\nAnd that.\n### Why?\n\nBecause.\n## \n"
    got = files.markdown_questions(spark.createDataFrame([("p", text)], "path string, value string")).orderBy("number").collect()
    assert [(r.question, r.answer) for r in got] == [("What?", "This.\n\nAnd that."), ("Why?", "Because.")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    files.write_by_category(rows, "kind", str(tmp_path / "k"))
    files.write_by_category(rows.where("id = 1").withColumn("id", F.lit(9)), "kind", str(tmp_path / "k"))
    assert sorted((r.id, r.kind) for r in spark.read.json(str(tmp_path / "k")).collect()) == [(2, "b"), (9, "a")]
    for _ in range(2):
        files.append_json_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "kind"]
    assert files.guarded_table("raw_1") == "raw_1"
    for bad in ("", "a b", "a;drop", "a.b"):
        with pytest.raises(ValueError):
            files.guarded_table(bad)


def documents(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"doc_id": i, "text": t, "version": v}) + "\n" for i, t, v in rows))


def test_stream_holds_what_a_batch_would(spark, tmp_path):
    source, index, checkpoint = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    first = [(1, "one\n" * 300, "2024-01-01T00:00:00Z"), (2, "two", "2024-01-01T00:00:00Z"), (2, "two again", "2024-01-02T00:00:00Z")]
    later = [(1, "one anew", "2024-02-01T00:00:00Z"), (3, None, "2024-02-01T00:00:00Z")]
    documents(source, "a.json", first)
    ingest.ingest(spark, str(source), index, checkpoint).awaitTermination()
    documents(source, "b.json", later)
    ingest.ingest(spark, str(source), index, checkpoint).awaitTermination()
    every = spark.read.schema(ingest.DOCUMENT).json(str(source))
    want = ingest.chunks_of(ingest.latest_versions(every)).select("chunk_id", "content_hash").collect()
    got = ingest.current_index(spark, index).select("chunk_id", "content_hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.chunk_id for r in got} == {"1-0", "2-0"}


def test_windowed_metrics_count_an_id_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([(1, day(1, 1), "view", 2.0), (1, day(1, 2), "view", 2.0), (2, day(1, 3), "view", 4.0), (3, day(9, 1), "click", 1.0)], schema).write.json(str(tmp_path / "e"))
    stream = ingest.windowed_metrics(spark.readStream.schema(schema).json(str(tmp_path / "e")))
    query = stream.writeStream.format("memory").queryName("metrics").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.event_type, r.n, r.avg_value) for r in spark.table("metrics").collect()] == [("view", 2, 3.0)]


def test_records_by_file_ending(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": "1"}\n\nbroken\n{"t": "2"}\n')
    (tmp_path / "b.ndjson").write_text('{"t": "3"}\n')
    (tmp_path / "c.json").write_text('[{"t": "4"}, {"t": "5"}]')
    (tmp_path / "d.json").write_text('{"items": [{"t": "6"}]}')
    (tmp_path / "e.txt").write_text('{"t": "7"}')
    assert sorted(r.t for r in files.json_by_ending(spark, str(tmp_path), "items", "t string").collect()) == list("123456")


def test_histories_indexes_and_imports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, kind string")
    path = lambda name: str(tmp_path / name)
    for _ in range(2):
        files.append_csv_history(rows, path("h"))
    assert spark.read.option("header", True).csv(path("h")).count() == 6
    files.rebuild_index(rows, path("i"))
    files.rebuild_index(rows.where("id = 1"), path("i"))
    assert [r.id for r in spark.read.parquet(path("i")).collect()] == [1]
    files.replace_import_types(rows, "kind", path("t"))
    files.replace_import_types(rows.where("id = 2").withColumn("id", F.col("id") + 10), "kind", path("t"))
    assert sorted((r.id, r.kind) for r in spark.read.parquet(path("t")).collect()) == [(1, "a"), (12, "b")]


def test_word_texts_with_tabs_breaks_blank_paragraphs_and_broken_files(spark, tmp_path):
    ns = files.WORD_NAMESPACE.strip("{}")
    body = "<w:p><w:r><w:t> a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c </w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>d</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "y.docx").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "z.docx", "w") as archive:
        archive.writestr("other.xml", "<x/>")
    assert [(r.line_no, r.line) for r in files.word_documents(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "a\tb\nc"), (1, "d")]
