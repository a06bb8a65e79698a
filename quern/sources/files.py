"""File sources and sinks: JSON documents and lines, CSV, partitioned exports, zipped word-processor texts."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Fixed value: the XML namespace of word-processor documents.
WORD_NAMESPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _reader(source: SparkSession | DataFrameReader) -> DataFrameReader:
    return source.read if isinstance(source, SparkSession) else source


def json_documents(source: SparkSession | DataFrameReader, path: str, items: str, schema: str) -> DataFrame:
    """One row an item of JSON files that are lists, or hold a list under ``items``, or are one object."""
    raw = _reader(source).text(path, wholetext=True).select("value")
    as_list = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"struct<`{items}`: array<struct<{schema}>>>")[items]
    one = F.array(F.from_json("value", f"struct<{schema}>"))
    chosen = F.when(F.trim("value").startswith("["), as_list).when(held.isNotNull(), held).otherwise(one)
    return raw.select(F.explode(chosen).alias("item")).where("item IS NOT NULL").select("item.*")


def json_by_ending(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """The records of a folder: lines of .jsonl and .ndjson files, lists or objects of .json files."""
    lines = tolerant_json_lines(spark.read.option("pathGlobFilter", "*.{jsonl,ndjson}"), path, schema)
    whole = json_documents(spark.read.option("pathGlobFilter", "*.json"), path, items, schema)
    return lines.unionByName(whole)


def tolerant_json_lines(source: SparkSession | DataFrameReader, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines; blank and malformed lines and other values are passed over."""
    lines = _reader(source).text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r._broken IS NULL").select("r.*").drop("_broken")


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _written(paragraph: ElementTree.Element) -> str:
    """What a paragraph shows: its runs' text, tabs and line breaks in order, without white space at its ends."""
    shows = {"t": lambda node: node.text or "", "tab": lambda _: "\t", "br": lambda _: "\n", "cr": lambda _: "\n"}
    found = []
    for node in paragraph.iter():
        name = node.tag.removeprefix(WORD_NAMESPACE)
        if node.tag != name and name in shows:
            found.append(shows[name](node))
    return "".join(found).strip()


@pandas_udf(ArrayType(StringType()))
def _paragraphs(content: pd.Series) -> pd.Series:
    """The paragraphs of zipped documents that are not blank; none of what is no such document."""

    def of(data: bytes) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open("word/document.xml") as body:
                tree = ElementTree.parse(body)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []
        return [text for text in map(_written, tree.iter(f"{WORD_NAMESPACE}p")) if text]

    return content.map(of)


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the paragraphs of .docx files that are not blank; broken files have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", F.posexplode(_paragraphs("content")).alias("line_no", "line"))


def numbered_questions(lines: DataFrame) -> DataFrame:
    """(path, section, number, question) of lines 'A. section' and 'n. question'."""
    from pyspark.sql import Window as W

    own = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(F.nullif(F.regexp_extract("line", r"^\s*([A-O])\.\s*(.+)$", 1), F.lit("")), ignorenulls=True).over(own))
    found = marked.withColumn("number", F.regexp_extract("line", r"^\s*(\d+)\.\s*(.+)$", 1)).where("number <> ''")
    return found.select("path", "section", F.col("number").cast("int").alias("number"), F.trim(F.regexp_extract("line", r"^\s*(\d+)\.\s*(.+)$", 2)).alias("question"))


def tagged_records(texts: DataFrame, question: str = "Q:", answer: str = "A:") -> DataFrame:
    """(path, number, category, question, answer) of '[n] category: … Q: … A: …' records in one text each."""
    records = texts.select("path", F.explode(F.split("value", r"(?m)^(?=\[\d+\])")).alias("r")).where(F.col("r").rlike(r"^\[\d+\]"))
    part = lambda p: F.trim(F.regexp_extract("r", p, 1))
    return records.select("path", part(r"^\[(\d+)\]").cast("int").alias("number"), part(r"category:\s*([^\n]*)").alias("category"), part(rf"(?s){question}\s*(.*?)\s*(?={answer})").alias("question"), part(rf"(?s){answer}\s*(.*?)\s*$").alias("answer"))


def markdown_questions(texts: DataFrame) -> DataFrame:
    """(path, number, question, answer) of '## question' headings and the text below each, one text a row."""
    sections = texts.select("path", F.posexplode(F.split("value", r"(?m)^##+ ")).alias("number", "s")).where("number > 0")
    part = lambda i: F.trim(F.regexp_extract("s", r"(?s)^([^\n]*)\n?\s*(.*?)\s*$", i))
    return sections.select("path", "number", part(1).alias("question"), part(2).alias("answer")).where("question <> ''")


def append_json_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_csv_history(df: DataFrame, path: str) -> None:
    """One more run's rows under those of the runs before it."""
    df.write.mode("append").option("header", True).csv(path)


def rebuild_index(chunks: DataFrame, path: str) -> None:
    """An index made anew: what was there goes."""
    chunks.write.mode("overwrite").parquet(path)


def replace_import_types(rows: DataFrame, kind: str, path: str) -> None:
    """All rows of the import types that ``rows`` has are replaced by them; other types stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind).parquet(path)


def write_by_category(df: DataFrame, category: str, path: str) -> None:
    """One folder a category; a later write replaces only the categories that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(category).json(path)


def guarded_table(name: str) -> str:
    """A table name of letters, digits and underscores, else an error."""
    if not name or not all(c.isascii() and (c.isalnum() or c == "_") for c in name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def jdbc_rows(spark: SparkSession, url: str, name: str, source_types: list[str], limit: int | None = None, **options: str) -> DataFrame:
    """A table's rows of some source types, oldest first and undated ones last; the filter goes to the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=guarded_table(name), **options).load()
    rows = rows.where(F.col("source_type").isin(source_types)).orderBy(F.asc_nulls_last("collected_at"), "id")
    return rows if limit is None else rows.limit(limit)
