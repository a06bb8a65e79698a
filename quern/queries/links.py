"""Links by containment: titles and dates in texts, subjects in titles. Titles come from the tables' own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import texts
from quern.operators.containment import best_links, longest_contained
from quern.sources.tables import table


def notice_links(spark: SparkSession, sf: str) -> DataFrame:
    """For each page the document that it is told of in: its heading's first two words stand in the text, or the number
    in its address does, or both; the same language counts."""
    p = table(spark, sf, "pages")
    heading = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    title = F.regexp_extract(heading, r"^(\S+ \S+)", 1)
    number = F.regexp_extract("url", r"/[a-z]{2}/([0-9]+)", 1)
    events = p.select(F.col("page_id").alias("event_id"), F.regexp_extract("url", r"/([a-z]{2})/[0-9]", 1).alias("kind"), title.alias("title"), F.array(number).alias("dates"))
    notices = table(spark, sf, "documents").select(F.col("doc_id").alias("notice_id"), F.col("lang").alias("kind"), "text")
    return best_links(events, notices)


def subject_links(spark: SparkSession, sf: str) -> DataFrame:
    """The subject of each message: its first word if that is one (HIGH), else the longest that it contains (LOW). Subjects
    are the words that begin the benchmark's texts; spaces and capitals do not count."""
    subjects = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", f"^({texts.WORD})", 1)).alias("subject")).where("length(subject) >= 2").distinct()
    plain = F.regexp_replace(F.lower("text"), texts.SPACE, "")
    m = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.lower(F.regexp_extract("text", f"^({texts.WORD})", 1)).alias("own"), plain.alias("plain"))
    exact = m.join(subjects.select(F.col("subject").alias("exact")), F.col("own") == F.col("exact"), "left").select("message", "exact", "plain")
    low = longest_contained(exact.where("exact IS NULL"), subjects, "message", "plain", "subject")
    joined = exact.select("message", "exact").join(low, "message", "left")
    return joined.select("message", F.coalesce("exact", "subject", F.lit("")).alias("subject"), F.when(F.col("exact").isNotNull(), "HIGH").otherwise("LOW").alias("confidence"))


QUERIES = {f.__name__: f for f in (notice_links, subject_links)}
ORACLES = {
    "notice_links": r"""WITH e AS (SELECT page_id AS event_id, regexp_extract(url, '/([a-z]{2})/[0-9]', 1) AS kind, regexp_extract(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '^(\S+ \S+)', 1) AS title,
            regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS number FROM pages),
        s AS (SELECT event_id, doc_id AS notice_id, (CASE WHEN title <> '' AND contains(text, title) THEN 2 ELSE 0 END + CASE WHEN number <> '' AND contains(text, number) THEN 1 ELSE 0 END + (kind = lang)::INT)::INT AS score FROM e, documents)
        SELECT event_id, notice_id, score FROM s WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, notice_id) = 1""",
    "subject_links": r"""WITH s AS (SELECT DISTINCT lower(regexp_extract(text, '^([\p{L}\p{N}_]+)', 1)) AS subject FROM benchmark), u AS (SELECT subject FROM s WHERE length(subject) >= 2),
        m AS (SELECT conv_id || '-' || turn AS message, lower(regexp_extract(text, '^([\p{L}\p{N}_]+)', 1)) AS own, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', '', 'g') AS plain FROM conversations),
        c AS (SELECT message, subject FROM m JOIN u ON contains(plain, subject) QUALIFY row_number() OVER (PARTITION BY message ORDER BY length(subject) DESC, subject) = 1)
        SELECT message, coalesce(u.subject, c.subject, '') AS subject, CASE WHEN u.subject IS NULL THEN 'LOW' ELSE 'HIGH' END AS confidence FROM m LEFT JOIN u ON u.subject = own LEFT JOIN c USING (message)""",
}
