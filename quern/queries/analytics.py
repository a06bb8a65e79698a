"""Aggregations: conditional counts, time series, groups, gaps, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import day_series
from quern.operators.ranking import duplicate_groups
from quern.sources.tables import table


def _conditional(types=("error", "purchase", "view")):
    rate = lambda kind: F.round(F.count_if(F.col("event_type") == kind) / F.count("*"), 4)
    return [F.count("*").alias("n_runs"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("avg_value"), *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types), rate("error").alias("error_rate")]


CONDITIONAL = """count(*) AS n_runs, round(coalesce(avg(value), 0.0), 6) AS avg_value,
    count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view,
    round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate"""


def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(*_conditional())


def quality_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(*_conditional()).orderBy("day")


def quality_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Runs joined with their users' segment; a blank or missing segment is 'unknown'."""
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = table(spark, sf, "events").join(segments, "user_id", "left")
    key = F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("unknown")).alias("segment")
    return joined.groupBy(key).agg(*_conditional()).orderBy(F.desc("n_runs"), "segment")


def route_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and shares of event types in descending order, with the mean value as a whole number."""
    counted = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("props", "$.k").cast("int") >= 50).alias("n_high"), F.floor(F.avg("value")).alias("avg_value"))
    total = table(spark, sf, "events").agg(F.count("*").alias("total"))
    return counted.join(total).select("event_type", "n", "n_high", "avg_value", F.round(100 * F.col("n") / F.col("total"), 2).alias("share")).orderBy(F.desc("n"), "event_type")


def json_props_agg(spark: SparkSession, sf: str) -> DataFrame:
    key = F.get_json_object("props", "$.k").cast("int")
    banded = table(spark, sf, "events").select("value", F.floor(key / 10).alias("band"))
    return banded.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def monthly_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def daily_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays between a user's first and last event without any."""
    days = table(spark, sf, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    spans = days.groupBy("user_id").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    every = spans.select("user_id", F.explode(day_series(F.col("low"), F.col("high"))).alias("day")).where(F.weekday("day") < 5)
    return every.join(days, ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n_empty"), F.min("day").alias("first_empty"))


def grouping_sets_report(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each flag and one for all."""
    lines = table(spark, sf, "lineitem")
    rolled = lines.rollup("l_returnflag").agg(F.grouping("l_returnflag").alias("g"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.round(100 * F.count_if(F.col("l_discount") >= 0.05) / F.count("*"), 2).alias("pass_rate"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("l_returnflag")).alias("category"), "n", "avg_quantity", "pass_rate")


def distinct_filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: distinct open orders, all orders; customers without orders have zeros."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    per = orders.groupBy("c_custkey").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("n_open"), F.count_distinct("o_orderpriority").alias("n_priorities"), F.count("*").alias("n_orders"))
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0)


def exists_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a customer has an urgent order, and how many orders."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") > 0).alias("has_urgent"), F.count("*").alias("n_orders"))
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("has_urgent", F.lit(False)).alias("has_urgent"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def evaluation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: values as scores of up to 12 evaluations a kind; 60 passes."""
    scored = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_type", F.when(F.col("value") >= 60, "PASS").when(F.col("value") < 5, "ABSENT").when(F.col("value") < 20, "RETAKE").otherwise("FAIL").alias("status"))
    per = scored.groupBy("user_id", "event_type").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "ABSENT", "RETAKE")), F.count("*").alias("n_taken"))
    remaining = F.greatest(F.lit(12) - F.col("n_taken"), F.lit(0))
    needed = F.greatest(F.lit(6) - F.col("n_pass"), F.lit(0))
    level = F.when(needed == 0, "SAFE").when(remaining == 0, "FAILED").when(needed > remaining, "DANGER").when((needed == remaining) | (F.col("n_fail") >= 4), "WARNING").when(F.col("n_fail") >= 2, "CAUTION").otherwise("SAFE")
    return per.select("user_id", "event_type", "n_pass", "n_fail", "n_absent", "n_retake", remaining.alias("n_remaining"), needed.alias("n_needed"), level.alias("risk_level"))


def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    """A user's overall level is the most severe of their kinds; users without results are at CAUTION."""
    order = ["SAFE", "CAUTION", "WARNING", "DANGER", "FAILED"]
    severity = F.array_position(F.array(*map(F.lit, order)), F.col("risk_level"))
    worst = evaluation_rollup(spark, sf).groupBy("user_id").agg(F.max_by("risk_level", severity).alias("level"))
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.join(worst, "user_id", "left").select("user_id", F.coalesce("level", F.lit("CAUTION")).alias("level"))


ROLLUP = """WITH s AS (SELECT user_id, event_type, CASE WHEN value >= 60 THEN 'PASS' WHEN value < 5 THEN 'ABSENT' WHEN value < 20 THEN 'RETAKE' ELSE 'FAIL' END AS status
        FROM events WHERE event_type IN ('view', 'click')),
    p AS (SELECT user_id, event_type, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'ABSENT') AS n_absent,
        count(*) FILTER (status = 'RETAKE') AS n_retake, greatest(12 - count(*), 0) AS n_remaining, greatest(6 - count(*) FILTER (status = 'PASS'), 0) AS n_needed FROM s GROUP BY ALL),
    r AS (SELECT *, CASE WHEN n_needed = 0 THEN 'SAFE' WHEN n_remaining = 0 THEN 'FAILED' WHEN n_needed > n_remaining THEN 'DANGER'
        WHEN n_needed = n_remaining OR n_fail >= 4 THEN 'WARNING' WHEN n_fail >= 2 THEN 'CAUTION' ELSE 'SAFE' END AS risk_level FROM p)"""


def weakness_map(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and kind: the latest value, the mean of the scored, the fails below 60."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.round(F.avg("value"), 6).alias("average"), F.count_if(F.col("value") < 60).alias("n_fail"), F.max("ts").alias("updated_at"))


def missing_required_set(spark: SparkSession, sf: str) -> DataFrame:
    """Event types that a user lacks on a day, of those required of all."""
    required = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    per = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("seen"))
    return per.select("user_id", "day", F.array_join(F.array_except(required, "seen"), ",").alias("missing")).where("missing <> ''")


def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer on one day with one priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "MM").alias("month"), "o_orderpriority")
    return duplicate_groups(o, ["o_custkey", "month", "o_orderpriority"], "o_orderkey")


def import_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts by source, one column an outcome."""
    d = table(spark, sf, "documents").select("source", F.when(F.length("text") < 200, "skipped").when(F.col("lang") == "en", "created").otherwise("updated").alias("outcome"))
    return d.groupBy("source").pivot("outcome", ["created", "updated", "skipped"]).count().na.fill(0)


def suspicious_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with reasons to doubt them, and how often each reason occurs."""
    o = table(spark, sf, "orders")
    reasons = F.filter(F.array(F.when(F.weekday("o_orderdate") >= 5, "weekend"), F.when(F.col("o_totalprice") > 400000, "price"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority").startswith("4"), "unspecified")), lambda r: r.isNotNull())
    return o.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def session_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Per title (part type): least start, greatest end, best score, first name, size."""
    p = table(spark, sf, "part")
    return p.groupBy("p_type").agg(F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"), F.round(F.max("p_retailprice"), 4).alias("best"), F.min_by("p_name", "p_partkey").alias("first_name"), F.count("*").alias("n"))


def average_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over an order's lines, nulls left out, folded over one array a row."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("boxes"))
    return lines.select("l_orderkey", F.round(F.try_divide(F.aggregate("boxes", F.lit(0.0), lambda s, x: s + x), F.size("boxes")), 6).alias("confidence"))


def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent words of each language; ties by the word."""
    from quern.functions.texts import word_tokens
    from quern.operators.ranking import first_n_per_key

    words = table(spark, sf, "documents").select("lang", F.explode(word_tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return first_n_per_key(words, ["lang"], [F.desc("n"), "word"], 10)


QUERIES = {
    f.__name__: f
    for f in (
        quality_summary, quality_timeseries, quality_by_group, route_metrics, json_props_agg, monthly_histogram, daily_gaps, grouping_sets_report, distinct_filtered_counts, exists_flag,
        evaluation_rollup, risk_level, weakness_map, missing_required_set, dup_groups, import_counters, suspicious_reasons, session_extremes, average_confidence, top_tokens,
    )
}

ORACLES = {
    "quality_summary": f"SELECT {CONDITIONAL} FROM events",
    "quality_timeseries": f"SELECT ts::DATE AS day, {CONDITIONAL} FROM events GROUP BY day",
    "quality_by_group": f"SELECT coalesce(nullif(trim(c_mktsegment), ''), 'unknown') AS segment, {CONDITIONAL} FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY segment",
    "route_metrics": """SELECT event_type, count(*) AS n, count(*) FILTER ((props->>'$.k')::INT >= 50) AS n_high, floor(avg(value))::BIGINT AS avg_value,
        round(100 * count(*) / (SELECT count(*) FROM events), 2) AS share FROM events GROUP BY event_type""",
    "json_props_agg": "SELECT floor((props->>'$.k')::INT / 10)::BIGINT AS band, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY band",
    "monthly_histogram": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY month",
    "daily_gaps": """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), s AS (SELECT user_id, min(day) lo, max(day) hi FROM d GROUP BY 1),
        e AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM s)
        SELECT user_id, count(*) AS n_empty, min(day) AS first_empty FROM e WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = e.user_id AND d.day = e.day) GROUP BY user_id""",
    "grouping_sets_report": """SELECT coalesce(l_returnflag, 'all') AS category, count(*) AS n, round(avg(l_quantity), 4) AS avg_quantity,
        round(100 * count(*) FILTER (l_discount >= 0.05) / count(*), 2) AS pass_rate FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))""",
    "distinct_filtered_counts": """SELECT c_custkey, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_orderpriority) AS n_priorities, count(o_orderkey) AS n_orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "exists_flag": """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent,
        (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer""",
    "evaluation_rollup": ROLLUP + " SELECT * FROM r",
    "risk_level": ROLLUP + """, w AS (SELECT user_id, max(list_position(['SAFE', 'CAUTION', 'WARNING', 'DANGER', 'FAILED'], risk_level)) AS m FROM r GROUP BY user_id)
        SELECT u.user_id, coalesce(['SAFE', 'CAUTION', 'WARNING', 'DANGER', 'FAILED'][m], 'CAUTION') AS level FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w USING (user_id)""",
    "weakness_map": """SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS latest, round(avg(value), 6) AS average, count(*) FILTER (value < 60) AS n_fail, max(ts) AS updated_at
        FROM events GROUP BY ALL""",
    "missing_required_set": """SELECT user_id, day, missing FROM (SELECT user_id, ts::DATE AS day, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda t: NOT list_contains(list(event_type), t)), ',') AS missing
        FROM events GROUP BY ALL) WHERE missing <> ''""",
    "dup_groups": """SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, count(*) AS n_rows, min(o_orderkey) AS kept, count(*) - 1 AS n_removed
        FROM orders GROUP BY ALL HAVING count(*) > 1""",
    "import_counters": """SELECT source, count(*) FILTER (length(text) >= 200 AND lang = 'en') AS created, count(*) FILTER (length(text) >= 200 AND lang <> 'en') AS updated,
        count(*) FILTER (length(text) < 200) AS skipped FROM documents GROUP BY source""",
    "suspicious_reasons": """SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' END, CASE WHEN o_totalprice > 400000 THEN 'price' END,
        CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN starts_with(o_orderpriority, '4') THEN 'unspecified' END]) AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason""",
    "session_extremes": """SELECT p_type, min(p_size) AS min_size, max(p_size) AS max_size, round(max(p_retailprice), 4) AS best, arg_min(p_name, p_partkey) AS first_name, count(*) AS n FROM part GROUP BY p_type""",
    "average_confidence": "SELECT l_orderkey, round(avg(l_quantity) FILTER (l_returnflag <> 'R'), 6) AS confidence FROM lineitem GROUP BY l_orderkey",
    "top_tokens": r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT lang, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 10""",
}
