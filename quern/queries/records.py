"""Records around posts, notifications and documents: visibility, previews, retention, upserts, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import texts
from quern.functions.rules import all_reasons, first_rule
from quern.operators import partitions
from quern.operators.matching import upsert
from quern.operators.ranking import first_per_key
from quern.queries.text import CHUNKS
from quern.sources.tables import table

USER, NOW = 7, "1998-06-15"


def visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without an owner (signups) or of one user, by columns that the scan reads alone."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", F.when(F.col("event_type") != "signup", F.col("user_id")).alias("owner_id"))
    return e.where(F.col("owner_id").isNull() | (F.col("owner_id") == USER)).select("event_id", "event_type", "owner_id")


def upcoming_prelimited(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 first orders from a day on; of those, what lies within a month and is visible to a segment."""
    now = F.lit(NOW).cast("timestamp_ntz")
    first = table(spark, sf, "orders").where(F.col("o_orderdate") >= now).orderBy("o_orderdate", "o_orderkey").limit(50)
    seen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return first.where(F.col("o_orderdate") <= F.lit("1998-07-15").cast("timestamp_ntz")).join(seen, "o_custkey", "left_semi").select("o_orderkey", "o_orderdate")


def post_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as posts: previews of 120 characters, deleted ones masked, authors named or not."""
    c = table(spark, sf, "conversations")
    gone = F.length("text") % 10 == 0
    author = F.coalesce(texts.blank_to_null(F.when(F.col("role") != "system", F.col("role"))), F.lit("unknown"))
    return c.select("conv_id", "turn", F.when(gone, "(deleted)").otherwise(F.substring(F.trim("text"), 1, 120)).alias("preview"), F.when(~gone, author).alias("author"))


def notification_window(spark: SparkSession, sf: str) -> DataFrame:
    """A user's unread or recent events, unread first, newest first, 80 at most; old errors are stale."""
    e = table(spark, sf, "events").where(F.col("user_id") == USER).withColumn("is_read", F.col("value") > 40)
    last = e.agg(F.max("ts").alias("last"))
    recent = F.col("ts") >= F.col("last") - F.expr("interval 7 days")
    stale = (F.col("event_type") == "error") & ~recent
    shown = e.join(last).where((~F.col("is_read") | recent) & ~stale)
    return shown.orderBy("is_read", F.desc("ts"), F.desc("event_id")).limit(80).select("event_id", "event_type", "is_read")


def retention_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type of what stays when read rows of over three days before the last go."""
    e = table(spark, sf, "events").withColumn("is_read", F.col("value") > 40)
    last = e.agg(F.max("ts").alias("last"))
    kept = e.join(last).where(~(F.col("is_read") & (F.col("ts") < F.col("last") - F.expr("interval 3 days"))))
    return kept.groupBy("event_type").agg(F.count("*").alias("n_kept"))


def notification_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Notifications by user and type: a later batch replaces those it has and adds the rest."""
    made = lambda kind: first_per_key(table(spark, sf, "events").where(F.col("event_type").isin(kind)), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")
    late = first_per_key(table(spark, sf, "events").where("event_type IN ('click', 'purchase')"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
    return upsert(made(["view", "click"]), late, ["user_id", "event_type"])


def protected_reparse(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order are made anew unless one is protected (shipped late): then the old ones stay. Lines of no order are new."""
    every = table(spark, sf, "lineitem")
    lines = every.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linestatus") == "F").alias("protected"))
    dealt = partitions.dealt(lines.where("l_orderkey IS NOT NULL"), every.count(), "l_orderkey")  # the count is read from the files' ends
    kept = F.coalesce(F.max("protected").over(W.partitionBy("l_orderkey")), F.lit(False))
    marked = dealt.withColumn("kept", kept).unionByName(lines.where("l_orderkey IS NULL").withColumn("kept", F.lit(False)))
    return marked.select("l_orderkey", "l_linenumber", F.when(F.col("kept"), F.col("l_quantity")).otherwise(F.col("l_quantity") * 2).alias("quantity"), F.when(F.col("kept"), "old").otherwise("new").alias("origin"))


def import_plan(spark: SparkSession, sf: str) -> DataFrame:
    """An import dry run: excluded with a reason, repeated within the batch by arrival, or created or updated."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", texts.fingerprint(F.col("text"), 64).alias("h"))
    reason = first_rule([(F.length(F.trim("text")) < 60, "too short"), (F.regexp_count("text", F.lit(r"\|")) > 20, "table"), (F.upper("text") == F.col("text"), "shouting")], None).cast("string")
    own = W.partitionBy("h").orderBy("doc_id")
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    marked = d.withColumn("reason", reason).withColumn("place", F.row_number().over(own)).join(known, "doc_id", "left")
    outcome = first_rule([(F.col("reason").isNotNull(), F.concat(F.lit("excluded: "), F.col("reason"))), (F.col("place") > 1, F.lit("repeated")), (F.col("known"), F.lit("updated"))], F.lit("created"))
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their chunks' number and outcome: nothing to embed is a failure; counted by source."""
    d = table(spark, sf, "documents").select("source", F.size(texts.paragraph_chunks(F.col("text"))).alias("n_chunks"))
    status = first_rule([(F.col("n_chunks") == 0, "FAILED"), (F.col("n_chunks") > 60, "PARTIAL")], "SUCCESS")
    return d.groupBy("source", status.alias("status")).agg(F.count("*").alias("n"), F.sum("n_chunks").alias("n_chunks"))


def event_documents(spark: SparkSession, sf: str) -> DataFrame:
    """An order and its lines as one text, lines in order, with sorted JSON metadata."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("l"))
    o = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    body = F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<l_linenumber:int,l_returnflag:string,l_linestatus:string>>")), lambda x: F.concat_ws(" ", x["l_linenumber"].cast("string"), x["l_returnflag"], x["l_linestatus"])), "\n")
    content = F.concat_ws("\n", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.nullif(body, F.lit("")))
    metadata = F.to_json(F.struct(F.size("l").alias("n"), F.col("o_orderstatus").alias("status")))
    return o.select("o_orderkey", F.md5(content).alias("content_md5"), F.when(F.col("l").isNotNull(), metadata).alias("metadata"))


def candidate_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one part and month merged: texts in order, sums, the first filled value."""
    l = table(spark, sf, "lineitem").select("l_partkey", F.trunc("l_shipdate", "MM").alias("month"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"))  # noqa: E741
    merged = l.groupBy("l_partkey", "month").agg(
        F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_returnflag"))).alias("t"), F.round(F.sum("l_quantity"), 4).alias("quantity"),
        F.min_by("tax", F.when(F.col("tax").isNotNull(), F.struct("l_orderkey", "l_linenumber"))).alias("first_tax"), F.count("*").alias("n"),
    ).where("n > 1")
    return merged.select("l_partkey", "month", F.array_join("t.l_returnflag", ",").alias("flags"), "quantity", "first_tax", "n")


def weekday_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Events a week and weekday, weekdays without any as zero, for every week that has events."""
    days = table(spark, sf, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    weeks = days.select(F.date_trunc("week", "day").cast("date").alias("week")).distinct()
    expected = weeks.select("week", F.explode(F.sequence("week", F.date_add("week", 4))).alias("day"))
    return expected.join(days, "day", "left").select("week", "day", F.coalesce("n", F.lit(0)).alias("n"))


def schedule_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a line: shipped before it was ordered, too long, at a weekend, without quantity."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")  # noqa: E741
    warnings = all_reasons([(F.col("l_shipdate") < F.col("o_orderdate"), "before"), (F.datediff("l_shipdate", "o_orderdate") > 100, "long"), (F.weekday("l_shipdate") >= 5, "weekend"), (F.col("l_quantity") < 2, "small")])
    return l.select("l_orderkey", "l_linenumber", F.array_join(warnings, ",").alias("warnings")).where("warnings <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        visible_rows, upcoming_prelimited, post_previews, notification_window, retention_prune, notification_upsert, protected_reparse, import_plan, ingest_status, event_documents, candidate_merge,
        weekday_coverage, schedule_warnings,
    )
}

_NORMAL = r"trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))"

ORACLES = {
    "visible_rows": f"SELECT event_id, event_type, CASE WHEN event_type <> 'signup' THEN user_id END AS owner_id FROM events WHERE event_type = 'signup' OR user_id = {USER}",
    "upcoming_prelimited": f"""SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' ORDER BY o_orderdate, o_orderkey LIMIT 50)
        WHERE o_orderdate <= TIMESTAMP '1998-07-15' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "post_previews": """SELECT conv_id, turn, CASE WHEN length(text) % 10 = 0 THEN '(deleted)' ELSE left(trim(text, ' '), 120) END AS preview,
        CASE WHEN length(text) % 10 <> 0 THEN coalesce(CASE WHEN role <> 'system' THEN nullif(trim(role), '') END, 'unknown') END AS author FROM conversations""",
    "notification_window": f"""WITH e AS (SELECT *, value > 40 AS is_read, ts >= max(ts) OVER () - INTERVAL 7 DAY AS recent FROM events WHERE user_id = {USER})
        SELECT event_id, event_type, is_read FROM e WHERE (NOT is_read OR recent) AND NOT (event_type = 'error' AND NOT recent) ORDER BY is_read, ts DESC, event_id DESC LIMIT 80""",
    "retention_prune": """SELECT event_type, count(*) AS n_kept FROM events WHERE NOT (value > 40 AND ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY) GROUP BY event_type""",
    "notification_upsert": """WITH o AS (SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
        n AS (SELECT user_id, event_type, arg_min(event_id, row(ts, event_id)) AS event_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL)
        SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""",
    "protected_reparse": """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, bool_or(l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN p THEN l_quantity ELSE l_quantity * 2 END AS quantity, CASE WHEN p THEN 'old' ELSE 'new' END AS origin FROM p""",
    "import_plan": rf"""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY {_NORMAL} ORDER BY doc_id) AS place, CASE WHEN length(trim(text, ' ')) < 60 THEN 'too short' WHEN len(regexp_extract_all(text, '\|')) > 20 THEN 'table'
            WHEN upper(text) = text THEN 'shouting' END AS reason FROM documents),
        o AS (SELECT d.doc_id, CASE WHEN reason IS NOT NULL THEN 'excluded: ' || reason WHEN place > 1 THEN 'repeated' WHEN l.doc_id IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id)
        SELECT outcome, count(*) AS n, min(doc_id) AS first_doc FROM o GROUP BY outcome""",
    "ingest_status": CHUNKS + """ SELECT source, CASE WHEN len(chunks) = 0 THEN 'FAILED' WHEN len(chunks) > 60 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, count(*) AS n, sum(len(chunks))::BIGINT AS n_chunks
        FROM e JOIN documents USING (doc_id) GROUP BY ALL""",
    "event_documents": """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ' ' || l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS b FROM lineitem GROUP BY 1)
        SELECT o_orderkey, md5('Order ' || o_orderkey || chr(10) || o_orderpriority || coalesce(chr(10) || b, '')) AS content_md5, CASE WHEN n IS NOT NULL THEN '{"n":' || n || ',"status":"' || o_orderstatus || '"}' END AS metadata
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "candidate_merge": """SELECT l_partkey, date_trunc('month', l_shipdate)::DATE AS month, string_agg(l_returnflag, ',' ORDER BY l_orderkey, l_linenumber, l_returnflag) AS flags, round(sum(l_quantity), 4) AS quantity,
        arg_min(l_tax, row(l_orderkey, l_linenumber)) FILTER (l_tax > 0.04) AS first_tax, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "weekday_coverage": """WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), w AS (SELECT DISTINCT date_trunc('week', day)::DATE AS week FROM d),
        e AS (SELECT week, week + i::INT AS day FROM w, range(0, 5) r(i)) SELECT week, day, coalesce(n, 0) AS n FROM e LEFT JOIN d USING (day)""",
    "schedule_warnings": """SELECT l_orderkey, l_linenumber, warnings FROM (SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_shipdate < o_orderdate THEN 'before' END,
        CASE WHEN l_shipdate::DATE - o_orderdate::DATE > 100 THEN 'long' END, CASE WHEN isodow(l_shipdate) >= 6 THEN 'weekend' END, CASE WHEN l_quantity < 2 THEN 'small' END], lambda r: r IS NOT NULL), ',') AS warnings
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE warnings <> ''""",
}
