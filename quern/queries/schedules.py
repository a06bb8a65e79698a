"""Schedule curation: groups of types, search, identity keys, quality reports, reading order, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.rules import first_rule
from quern.sources.tables import table

#: A filter name stands for several types.
GROUPS = {"important": ["error", "purchase"], "other": ["signup", "view", "click"]}
#: Aliases of tracks; the longest that a text has decides.
ALIASES = {"red": "colour", "red w": "warm", "hot": "warm", "small": "size", "large": "size", "small g": "parts"}


def event_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type").isin(GROUPS["important"])).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def search_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold a term in any case, over several fields; a term's wildcards are plain characters."""
    d = table(spark, sf, "documents")
    hay = F.lower(F.concat_ws("\n", "source", "lang", "text"))
    return d.where(F.contains(hay, F.lit("src1")) & F.contains(hay, F.lit("that"))).select("doc_id", "lang")


def identity_merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with one identity (customer, week, half of the priority): size, kept, the ids that would go."""
    key = [F.col("o_custkey"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"), (F.substring("o_orderpriority", 1, 1) <= "2").alias("urgent")]
    o = table(spark, sf, "orders").groupBy(*key).agg(F.min_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("kept"), F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    many = o.where(F.size("members") > 1)
    return many.select("o_custkey", "week", "urgent", "kept", F.array_join(F.array_remove("members", F.col("kept")).cast("array<string>"), ",").alias("removed"))


def skip_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons within JSON arrays, exploded and counted; a malformed array has none."""
    raw = F.when(F.col("event_id") % 50 == 0, F.lit("[oops")).otherwise(F.to_json(F.array(F.struct(F.col("event_type").alias("reason")), F.struct((F.floor(F.col("value") / 30)).cast("string").alias("reason")))))
    parsed = F.from_json(raw, "array<struct<reason:string>>")
    return table(spark, sf, "events").select(F.explode(parsed).alias("r")).where("r.reason IS NOT NULL").groupBy(F.col("r.reason").alias("reason")).agg(F.count("*").alias("n"))


def section_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are section heads of a user's events: each section's range ends where the next begins."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("low"), F.lead("ts").over(own).alias("high"), F.row_number().over(own).alias("section"))


def notice_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 rows: dated ones first, by date, then price, then id, each descending."""
    dated = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    o = table(spark, sf, "orders").select("o_orderkey", dated.alias("published"), "o_totalprice")
    return o.orderBy(F.col("published").desc_nulls_last(), F.desc("o_totalprice"), F.desc("o_orderkey")).limit(40).select("o_orderkey", "published")


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as boxes read from top to bottom in bands of 10, then from left to right."""
    boxes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.floor(F.col("l_quantity") / 10).alias("band"), F.col("l_extendedprice").alias("x"), F.col("l_linenumber").alias("line")))).alias("b"))
    return boxes.select("l_orderkey", F.array_join(F.col("b.line").cast("array<string>"), " ").alias("lines"))


def followup_rank(spark: SparkSession, sf: str) -> DataFrame:
    """What 'the second' refers to: of a session's last answer the second sentence, none if it has one."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    sentences = F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return c.select("conv_id", F.size(sentences).alias("n_sentences"), F.md5(F.coalesce(F.try_element_at(sentences, F.lit(2)), F.lit(""))).alias("second_md5"))


def month_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per month: orders, those made by hand, at weekends, repeated ones, and weekdays without any."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day")).withColumn("month", F.trunc("day", "MM"))
    per_day = o.groupBy("month", "day").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("manual"), (F.count("*") - F.count_distinct("o_custkey")).alias("repeated"))
    weekdays = F.size(F.filter(F.sequence("month", F.last_day("month")), lambda d: F.weekday(d) < 5))
    report = per_day.groupBy("month").agg(F.sum("n").alias("n_orders"), F.sum("manual").alias("n_manual"), F.sum(F.when(F.weekday("day") >= 5, F.col("n")).otherwise(0)).alias("n_weekend"), F.sum("repeated").alias("n_repeated"), F.count_if(F.weekday("day") < 5).alias("n_days"))
    return report.select("month", "n_orders", "n_manual", "n_weekend", "n_repeated", (weekdays - F.col("n_days")).alias("n_empty_weekdays"), F.round(F.col("n_manual") / F.col("n_orders"), 4).alias("manual_ratio"))


def route_last_n(spark: SparkSession, sf: str) -> DataFrame:
    """Shares among the last 1,000 runs of the log, with mean values that leave zeros out."""
    last = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(100 * F.count("*") / 1000, 2).alias("share"), F.round(F.avg(F.nullif("value", F.lit(0.0))), 6).alias("avg_value"))


def track_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The track of the longest alias in a part's name, else of its type, else unclassified; counted."""
    by_length = sorted(ALIASES, key=lambda a: (-len(a), a))
    track = first_rule([(F.contains("p_name", F.lit(a)), F.lit(ALIASES[a])) for a in by_length], F.when(F.col("p_type") == "LARGE", "size"))
    return table(spark, sf, "part").groupBy(F.coalesce(track, F.lit("unclassified")).alias("track")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def duplicate_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Manual orders (status P) with a generated twin of the same customer and month: they would go."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "MM").alias("month"), "o_orderstatus")
    twins = o.where("o_orderstatus <> 'P'").select("o_custkey", "month")
    return o.where("o_orderstatus = 'P'").join(twins, ["o_custkey", "month"], "left_semi").select("o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (event_group_filter, search_contains, identity_merge_groups, skip_reason_counts, section_ranges, notice_order, reading_order, followup_rank, month_quality_report, route_last_n, track_inference, duplicate_twins)
}

_ALIAS = " ".join(f"WHEN contains(p_name, '{a}') THEN '{ALIASES[a]}'" for a in sorted(ALIASES, key=lambda a: (-len(a), a)))

ORACLES = {
    "event_group_filter": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE event_type IN ('error', 'purchase') GROUP BY event_type",
    "search_contains": "SELECT doc_id, lang FROM documents WHERE contains(lower(source || chr(10) || lang || chr(10) || text), 'src1') AND contains(lower(source || chr(10) || lang || chr(10) || text), 'that')",
    "identity_merge_groups": """WITH k AS (SELECT o_custkey, date_trunc('week', o_orderdate)::DATE AS week, left(o_orderpriority, 1) <= '2' AS urgent, arg_min(o_orderkey, row(o_orderdate, -o_orderkey)) AS kept, list(o_orderkey ORDER BY o_orderkey) AS m
        FROM orders GROUP BY ALL HAVING count(*) > 1) SELECT o_custkey, week, urgent, kept, array_to_string(list_filter(m, lambda x: x <> kept), ',') AS removed FROM k""",
    "skip_reason_counts": """SELECT reason, count(*) AS n FROM (SELECT unnest([event_type, floor(value / 30)::BIGINT::VARCHAR]) AS reason FROM events WHERE event_id % 50 <> 0) WHERE reason IS NOT NULL GROUP BY reason""",
    "section_ranges": """WITH h AS (SELECT user_id, event_id, ts AS low, lead(ts) OVER w AS high, (row_number() OVER w)::INT AS section FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT * FROM h""",
    "notice_order": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS published FROM orders ORDER BY published DESC NULLS LAST, o_totalprice DESC, o_orderkey DESC LIMIT 40""",
    "reading_order": "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY floor(l_quantity / 10), l_extendedprice, l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey",
    "followup_rank": """WITH c AS (SELECT conv_id, list_filter(list_transform(string_split(arg_max(text, turn), '.'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT conv_id, len(s)::INT AS n_sentences, md5(coalesce(s[2], '')) AS second_md5 FROM c""",
    "month_quality_report": """WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderdate::DATE AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS manual, count(*) - count(DISTINCT o_custkey) AS repeated FROM orders GROUP BY ALL),
        r AS (SELECT month, sum(n)::BIGINT AS n_orders, sum(manual)::BIGINT AS n_manual, coalesce(sum(n) FILTER (isodow(day) >= 6), 0)::BIGINT AS n_weekend, sum(repeated)::BIGINT AS n_repeated, count(*) FILTER (isodow(day) < 6) AS n_days FROM d GROUP BY month)
        SELECT month, n_orders, n_manual, n_weekend, n_repeated, len(list_filter(generate_series(month, last_day(month), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - n_days AS n_empty_weekdays, round(n_manual / n_orders, 4) AS manual_ratio FROM r""",
    "route_last_n": """SELECT event_type, count(*) AS n, round(100 * count(*) / 1000, 2) AS share, round(avg(nullif(value, 0.0)), 6) AS avg_value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY event_type""",
    "track_inference": f"SELECT coalesce(CASE {_ALIAS} WHEN p_type = 'LARGE' THEN 'size' END, 'unclassified') AS track, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1",
    "duplicate_twins": """SELECT o_orderkey FROM orders p WHERE o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM orders g WHERE g.o_orderstatus <> 'P' AND g.o_custkey = p.o_custkey AND date_trunc('month', g.o_orderdate) = date_trunc('month', p.o_orderdate))""",
}
