"""What a chunk carries of its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Details that every chunk has, with the detail that stands in for a missing one.
DETAILS = (("event_type", None), ("start_date", None), ("end_date", "start_date"), ("campus", None), ("generation", None), ("track", None))


def chunk_rows(documents: DataFrame, chunks: Column) -> DataFrame:
    """(chunk_id, document_id, raw_id, title, document_type, chunk_no, content, metadata) of each chunk, from documents (document_id, raw_id, title,
    document_type, details map<string,string>).

    metadata has the document's details, then what identifies it, which details of those names do not change; details that all
    chunks have are empty where the document has none, and the source is of the document's type. Null details are none."""
    own = F.coalesce("details", F.create_map().cast("map<string,string>"))
    each = documents.withColumn("details", own).select("document_id", "raw_id", "title", "document_type", "details", F.posexplode(chunks).alias("chunk_no", "content"))
    detail = lambda name, other: F.coalesce(F.try_element_at("details", F.lit(name)), other)
    filled = {name: detail(name, detail(instead, F.lit("")) if instead else F.lit("")) for name, instead in DETAILS}
    text = lambda c: F.col(c).cast("string")
    fixed = {
        "document_id": text("document_id"), "ai_document_id": text("document_id"), "raw_data_id": text("raw_id"), "document_type": F.col("document_type"),
        "source_type": detail("source_type", F.col("document_type")), **filled, "title": F.col("title"), "chunk_index": text("chunk_no"),
    }
    known = F.create_map(*(part for name, value in fixed.items() for part in (F.lit(name), value)))
    rest = F.map_filter("details", lambda k, _: ~k.isin(*fixed))
    chunk_id = F.concat_ws(":", "document_id", "chunk_no")
    return each.select(chunk_id.alias("chunk_id"), "document_id", "raw_id", "title", "document_type", "chunk_no", "content", F.map_concat(rest, known).alias("metadata"))
