"""Content, images and links of whole web pages, read from their trees of elements.

No SQL stands beside these: nesting is beyond regular expressions. The tests hold them against a walk over the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import pages
from quern.sources.tables import table


def page_content(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each page that holds its content, with its title, score and kind."""
    trees = pages.with_content(pages.with_trees(table(spark, sf, "pages"), "page_id", "url"))
    text = trees.withColumn("text", pages.content_text())
    title = F.coalesce(F.nullif("heading", F.lit("")), F.nullif("document_title", F.lit("")), F.lit("document"))
    return text.select("page_id", F.md5(title).alias("title_md5"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), F.col("content.score").alias("score"), "quality")


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of each page's images, those of its content before those of the rest."""
    trees = pages.with_content(pages.with_trees(table(spark, sf, "pages"), "page_id", "url"))
    found = trees.withColumn("found", pages.absolute_images(F.col("url")))
    return found.select("page_id", F.size("found").alias("n_images"), F.md5(F.array_join("found", " ")).alias("images_md5"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's links that have one of the words in their address or text."""
    trees = pages.with_trees(table(spark, sf, "pages"), "page_id", "url")
    found = trees.select("page_id", F.explode(pages.keyword_links(F.col("url"), ("the", "der", "la", "en"))).alias("link"))
    return found.select("page_id", "link.url", "link.title")


QUERIES = {f.__name__: f for f in (page_content, page_images, page_links)}
ORACLES: dict[str, str] = {}
