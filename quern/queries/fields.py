"""JSON, map and array fields; titles, URLs and dates within texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import texts, times
from quern.functions.rules import first_rule
from quern.sources.tables import table


def json_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several JSON paths whose value is a number; malformed values count as missing."""
    path = lambda p: F.expr(f"try_cast(get_json_object(props, '{p}') AS INT)")
    return table(spark, sf, "events").select("event_id", F.coalesce(path("$.missing"), path("$.deep.k"), path("$.k")).alias("k"))


def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults put under an event's own values, as JSON with sorted keys for comparison."""
    own = F.from_json("props", "map<string,string>")
    base = F.create_map(F.lit("k"), F.lit("-1"), F.lit("kind"), F.col("event_type"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(F.col("own"), k)), F.col("own"))
    e = table(spark, sf, "events").withColumn("own", own)
    return e.select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("merged"))


def alias_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's distinct priorities in order of arrival, the last three, and whether all required are there."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("o"))
    distinct = F.array_distinct("o.o_orderpriority")
    last = F.when(F.size(distinct) > 3, F.slice(distinct, -3, 3)).otherwise(distinct)
    required = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return o.select("o_custkey", F.array_join(last, "|").alias("aliases"), (F.size(F.array_except(required, distinct)) == 0).alias("complete"))


def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The axis-aligned box around an order's points (line number and quantity), and its area."""
    points = F.collect_list(F.struct(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y")))
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(points.alias("p"))
    low = lambda c: F.array_min(F.transform("p", lambda v: v[c]))
    high = lambda c: F.array_max(F.transform("p", lambda v: v[c]))
    return p.select("l_orderkey", low("x").alias("x1"), high("x").alias("x2"), low("y").alias("y1"), high("y").alias("y2"), F.round((high("x") - low("x")) * (high("y") - low("y")), 4).alias("area"))


def url_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    """URLs without fragment, tracking parameters and closing slash, scheme and host in lower case."""
    u = F.regexp_replace("url", "#.*$", "")
    u = F.regexp_replace(u, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"/$", "")
    host = F.lower(F.regexp_extract(u, r"^([a-z]+://[^/?]+)", 1))
    return table(spark, sf, "pages").select("page_id", F.concat(host, F.regexp_extract(u, r"^[a-z]+://[^/?]+(.*)$", 1)).alias("url_key"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).cast("string").alias("page_no"))


def display_titles(spark: SparkSession, sf: str) -> DataFrame:
    """First lines without leading marks, up to four times, 80 characters; meaningless ones are told."""
    t = F.substring_index("text", "\n", 1)
    for _ in range(4):
        t = F.regexp_replace(F.trim(t), r"^(\[[^\]]*\]|[-*|#>.]+)\s*", "")
    d = table(spark, sf, "documents").select("doc_id", F.trim(F.substring(t, 1, 80)).alias("title"))
    meaningless = (F.length("title") <= 2) | F.col("title").rlike(r"^[\d\s.:/-]+$") | F.lower("title").isin("the", "untitled", "of the")
    return d.select("doc_id", "title", meaningless.alias("meaningless"))


def section_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of what stands before and after a text's second line break; none for what is blank."""
    parts = F.split("text", "\n", 3)
    body = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", texts.fingerprint(F.concat_ws("\n", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))).alias("head_hash"), texts.fingerprint(body).alias("body_hash"))


def relative_dates(spark: SparkSession, sf: str) -> DataFrame:
    """What a word for a time means on an order's day: a range, and whether it is one day."""
    day, word = F.to_date("o_orderdate"), F.element_at(F.array(*map(F.lit, ("today", "tomorrow", "this week", "next week", "this month", "next month", "someday"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", day.alias("d"), word.alias("word"))
    d, w = F.col("d"), F.col("word")
    none = F.lit(None).cast("date")
    low = first_rule([(w == "today", d), (w == "tomorrow", F.date_add(d, 1)), (w == "this week", times.week_start(d)), (w == "next week", F.date_add(times.week_start(d), 7)), (w == "this month", times.month_start(d)), (w == "next month", times.month_start(d, 1))], none)
    high = first_rule([(w == "today", d), (w == "tomorrow", F.date_add(d, 1)), (w == "this week", times.week_end(d)), (w == "next week", F.date_add(times.week_end(d), 7)), (w == "this month", times.month_end(d)), (w == "next month", times.month_end(d, 1))], none)
    return o.select("o_orderkey", "word", low.alias("low"), high.alias("high"), w.isin("today", "tomorrow").alias("exact"))


def metadata_date_filter(spark: SparkSession, sf: str) -> DataFrame:
    """ISO dates compared as text: a range that overlaps, a missing end taken as the start, blank passing."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", iso("l_shipdate").alias("start_date"), F.when(F.col("l_quantity") > 25, iso(F.date_add("l_shipdate", 10))).alias("end_date"))  # noqa: E741
    low, high = "1997-05-01", "1997-05-20"
    return l.where((F.col("start_date") <= high) & (F.coalesce("end_date", "start_date") >= low)).select("l_orderkey", "l_linenumber", "start_date", "end_date")


def answer_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without role marks and code fences, with doubtful claims softened where nothing is cited."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?is)^(assistant|answer)\s*:\s*", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)```.*?```", ""), r"[ \t\n\x0B\f\r]+", " "))
    soft = F.when(F.col("t").rlike("(?i)must|always|la ") & ~F.contains("t", F.lit("http")), F.concat(F.lit("As far as known: "), F.col("t"))).otherwise(F.col("t"))
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", t.alias("t"))
    return c.select("conv_id", "turn", F.md5(soft).alias("answer_md5"), F.length("t").alias("n_chars"))


def intent_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """A model's JSON made safe: allowed filters only, confidence between 0 and 1, whole limits from 1 to 20."""
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.lit("high")).otherwise((F.col("value") / 50).cast("string")).alias("confidence"), (F.col("event_id") % 40).alias("limit"), F.array(F.col("event_type"), F.lit("drop table")).alias("filters")))
    parsed = F.from_json(raw, "confidence string, `limit` int, filters array<string>")
    e = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    allowed = F.array(F.lit("view"), F.lit("click"), F.lit("error"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("p.confidence").try_cast("double"), F.lit(0.0))))
    return e.select("event_id", F.round(confidence, 6).alias("confidence"), F.greatest(F.lit(1), F.least(F.lit(20), F.col("p.limit"))).alias("limit_n"), F.array_join(F.array_intersect("p.filters", allowed), ",").alias("filters"))


def ordinal_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Sort keys of display: a type's place (unknown last), the start, the title; the third of each user."""
    from quern.operators.ranking import first_per_key

    place = F.coalesce(F.create_map(*(F.lit(x) for pair in {"error": 1, "purchase": 2, "view": 3}.items() for x in pair))[F.col("event_type")], F.lit(99))
    e = table(spark, sf, "events").withColumn("place", place)
    return first_per_key(e, ["user_id"], ["place", "ts", "event_id"], rank=3).select("user_id", "event_id", "place")


QUERIES = {
    f.__name__: f
    for f in (json_waterfall, map_merge, alias_merge, bounding_boxes, url_normal_form, display_titles, section_hashes, relative_dates, metadata_date_filter, answer_cleaning, intent_coercion, ordinal_rank)
}

_N = r"trim(regexp_replace(lower({}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_FP = lambda x: f"CASE WHEN {_N.format(x)} = '' THEN '' ELSE left(sha256({_N.format(x)}), 16) END"
_title = "split_part(text, chr(10), 1)"
for _ in range(4):
    _title = rf"regexp_replace(trim({_title}, ' '), '^(\[[^\]]*\]|[-*|#>.]+)\s*', '')"
_url = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '')"

ORACLES = {
    "json_waterfall": "SELECT event_id, coalesce(try_cast(props->>'$.missing' AS INT), try_cast(props->>'$.deep.k' AS INT), try_cast(props->>'$.k' AS INT)) AS k FROM events",
    "map_merge": """SELECT event_id, '{"k":"' || coalesce(props->>'$.k', '-1') || '","kind":"' || event_type || '"}' AS merged FROM events""",
    "alias_merge": """WITH f AS (SELECT o_custkey, o_orderpriority, min(row(o_orderdate, o_orderkey)) AS first FROM orders GROUP BY ALL),
        a AS (SELECT o_custkey, list(o_orderpriority ORDER BY first) AS p FROM f GROUP BY o_custkey)
        SELECT o_custkey, array_to_string(CASE WHEN len(p) > 3 THEN p[-3:] ELSE p END, '|') AS aliases, list_has_all(p, ['1-URGENT', '2-HIGH']) AS complete FROM a""",
    "bounding_boxes": """SELECT l_orderkey, min(l_linenumber) AS x1, max(l_linenumber) AS x2, min(l_quantity) AS y1, max(l_quantity) AS y2,
        round((max(l_linenumber) - min(l_linenumber)) * (max(l_quantity) - min(l_quantity)), 4) AS area FROM lineitem GROUP BY l_orderkey""",
    "url_normal_form": rf"""WITH u AS (SELECT page_id, url, {_url} AS u FROM pages)
        SELECT page_id, lower(regexp_extract(u, '^([a-z]+://[^/?]+)', 1)) || regexp_extract(u, '^[a-z]+://[^/?]+(.*)$', 1) AS url_key, regexp_extract(url, '[?&]page=(\d+)', 1) AS page_no FROM u""",
    "display_titles": rf"""WITH t AS (SELECT doc_id, trim(left({_title}, 80), ' ') AS title FROM documents)
        SELECT doc_id, title, length(title) <= 2 OR regexp_matches(title, '^[\d\s.:/-]+$') OR lower(title) IN ('the', 'untitled', 'of the') AS meaningless FROM t""",
    "section_hashes": f"""WITH p AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS h, array_to_string(string_split(text, chr(10))[3:], chr(10)) AS b FROM documents)
        SELECT doc_id, {_FP('h')} AS head_hash, {_FP('b')} AS body_hash FROM p""",
    "relative_dates": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, ['today', 'tomorrow', 'this week', 'next week', 'this month', 'next month', 'someday'][o_orderkey % 7 + 1] AS word FROM orders),
        b AS (SELECT *, date_trunc('week', d)::DATE AS w, date_trunc('month', d)::DATE AS m FROM o)
        SELECT o_orderkey, word, CASE word WHEN 'today' THEN d WHEN 'tomorrow' THEN d + 1 WHEN 'this week' THEN w WHEN 'next week' THEN w + 7 WHEN 'this month' THEN m WHEN 'next month' THEN (m + INTERVAL 1 MONTH)::DATE END AS low,
        CASE word WHEN 'today' THEN d WHEN 'tomorrow' THEN d + 1 WHEN 'this week' THEN w + 6 WHEN 'next week' THEN w + 13 WHEN 'this month' THEN last_day(m) WHEN 'next month' THEN last_day((m + INTERVAL 1 MONTH)::DATE) END AS high,
        word IN ('today', 'tomorrow') AS exact FROM b""",
    "metadata_date_filter": """WITH l AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS start_date, CASE WHEN l_quantity > 25 THEN strftime(l_shipdate + INTERVAL 10 DAY, '%Y-%m-%d') END AS end_date FROM lineitem)
        SELECT * FROM l WHERE start_date <= '1997-05-20' AND coalesce(end_date, start_date) >= '1997-05-01'""",
    "answer_cleaning": r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)^(assistant|answer)\s*:\s*', ''), '(?s)```.*?```', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t
            FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '(?i)must|always|la ') AND NOT contains(t, 'http') THEN 'As far as known: ' || t ELSE t END) AS answer_md5, length(t) AS n_chars FROM c""",
    "intent_coercion": """SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(value / 50, 0.0))) END, 6) AS confidence, greatest(1, least(20, event_id % 40))::INT AS limit_n,
        CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE '' END AS filters FROM events""",
    "ordinal_rank": """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 99 END AS place FROM events)
        SELECT user_id, event_id, place FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place, ts, event_id) = 3""",
}
