"""Intervals, overrides, calendar arithmetic and visibility rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import times
from quern.operators import intervals
from quern.operators.ranking import islands, page
from quern.sources.tables import table

LOW, HIGH, NOW = "1996-03-01", "1996-03-31", "1996-03-15"


def _shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events: from the order's day to its last shipment; a deadline of 90 days for urgent ones."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("end_at"))
    orders = table(spark, sf, "orders").join(last, "o_orderkey")
    deadline = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_add("o_orderdate", 90).cast("timestamp_ntz"))
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias("start_at"), "end_at", deadline.alias("deadline_at"))


SHIPMENTS = """WITH l AS (SELECT l_orderkey, max(l_shipdate) AS end_at FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate AS start_at, end_at,
        CASE WHEN o_orderpriority = '1-URGENT' THEN (o_orderdate::DATE + 90)::TIMESTAMP END AS deadline_at FROM orders JOIN l ON l_orderkey = o_orderkey)"""


def _bounds():
    return F.lit(LOW).cast("timestamp_ntz"), F.lit(HIGH).cast("timestamp_ntz")


def interval_overlap_incl(spark: SparkSession, sf: str) -> DataFrame:
    low, high = _bounds()
    s = _shipments(spark, sf)
    return s.where(intervals.occurs(F.col("start_at"), F.col("end_at"), F.col("deadline_at"), low, high)).select("o_orderkey", "start_at", "end_at")


def interval_overlap_excl(spark: SparkSession, sf: str) -> DataFrame:
    low, high = _bounds()
    s = _shipments(spark, sf)
    return s.where(intervals.occurs(F.col("start_at"), F.col("end_at"), F.col("deadline_at"), low, high, inclusive=False)).select("o_orderkey", "start_at", "end_at")


def active_or_future(spark: SparkSession, sf: str) -> DataFrame:
    s = _shipments(spark, sf).where(intervals.active_or_future(F.col("deadline_at"), F.col("end_at"), F.col("start_at"), F.lit("1998-06-01").cast("timestamp_ntz")))
    return s.select("o_orderkey", "deadline_at", "end_at")


def override_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a user's overrides (a first line of over 30 pieces moves the start to its shipping day),
    hidden ones (returned lines) taken out, and the range tested on the effective values."""
    low, high = _bounds()
    links = table(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_quantity") > 30, F.col("l_shipdate")).alias("override_start_at"),
        F.when(F.col("l_linestatus") == "F", "done").alias("override_o_orderpriority"),
        (F.col("l_returnflag") == "R").alias("is_hidden"),
    )
    effective = intervals.with_overrides(_shipments(spark, sf), links, ["o_orderkey"], ["start_at", "o_orderpriority"])
    shown = effective.where(~F.coalesce("is_hidden", F.lit(False)) & intervals.overlaps_inclusive(F.col("start_at"), F.col("end_at"), low, high))
    return shown.select("o_orderkey", "start_at", "end_at", "o_orderpriority")


def hidden_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Events that no returned line hides."""
    hidden = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(hidden, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def calendar_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Week and month bounds, week of the month, neighbouring months of each order day."""
    day = F.to_date("o_orderdate")
    days = table(spark, sf, "orders").select(day.alias("day")).distinct()
    d = F.col("day")
    return days.select(
        "day", times.week_start(d).alias("week_start"), times.week_end(d).alias("week_end"), times.month_start(d).alias("month_start"), times.month_end(d).alias("month_end"),
        times.month_start(d, 1).alias("next_start"), times.month_end(d, -1).alias("previous_end"), times.week_of_month(d).alias("week_of_month"),
        times.weekday(d).alias("weekday"), times.nearest_weekday(d, 2).alias("wednesday"),
        F.date_sub(d, 365).alias("low"), F.date_add(d, 365).alias("high"),
    )


def day_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Days left to an order's deadline, as a badge, an urgency and a flag of long events (three days or more)."""
    today = F.lit(NOW).cast("date")
    s = _shipments(spark, sf).where("deadline_at IS NOT NULL")
    left = times.days_until(F.to_date("deadline_at"), today)
    urgency = F.when(left <= 1, 40).when(left <= 3, 30).when(left <= 7, 20).when(left <= 14, 10).otherwise(0)
    return s.select("o_orderkey", times.day_badge(F.to_date("deadline_at"), today).alias("badge"), left.alias("days_left"), urgency.alias("urgency"), (F.datediff("end_at", "start_at") >= 3).alias("is_long"))


def weekday_series(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each weekday of the 21 days from an order's day on, without fixed holidays."""
    holidays = spark.createDataFrame([(m, d) for m, d in HOLIDAYS], "month int, day_of_month int")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("low"))
    days = o.select("o_orderkey", F.explode(intervals.day_series(F.col("low"), F.date_add("low", 20))).alias("day")).where(F.weekday("day") < 5)
    marked = days.withColumn("month", F.month("day")).withColumn("day_of_month", F.dayofmonth("day"))
    return marked.join(F.broadcast(holidays), ["month", "day_of_month"], "left_anti").select("o_orderkey", "day")


# Holidays that fall on the same date each year, as month and day.
HOLIDAYS = ((1, 1), (3, 1), (5, 5), (6, 6), (8, 15), (10, 3), (10, 9), (12, 25))


def consecutive_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days with errors; of a run of four days or more only the first three stay."""
    days = table(spark, sf, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    marked = islands(days, ["user_id"], "day")
    return marked.where("run_length < 4 OR run_position <= 3").select("user_id", "day", "island", F.col("run_length").cast("int").alias("run_length"), "run_position")


def visibility_case(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that fits decides whether an event is shown, and why."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(F.col("event_type") == "signup", "always").when(k.isNull(), "no metadata").when((F.col("event_type") == "error") & (k < 30), "noise").when(k % 7 == 0, "source").when(F.weekday("ts") >= 5, "weekend").otherwise("default")
    return e.select("event_id", reason.alias("reason"), reason.isin("always", "default").alias("visible"))


def audience_match(spark: SparkSession, sf: str) -> DataFrame:
    """How many suppliers suit each customer, and the first: of their nation and of the same band, where a null on
    either side fits (an account below zero has no band). Suppliers are counted by nation and band first."""
    band = lambda c: F.when(F.col(c) >= 0, F.floor(F.col(c) / 2000)).alias("band")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), band("s_acctbal"))
    per = s.groupBy("nation", "band").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))
    every = per.groupBy("nation").agg(F.sum("n").alias("n_all"), F.min("first").alias("first_all"), F.sum(F.when(F.col("band").isNull(), F.col("n"))).alias("n_open"), F.min(F.when(F.col("band").isNull(), F.col("first"))).alias("first_open"))
    joined = c.join(every, "nation").join(per.where("band IS NOT NULL"), ["nation", "band"], "left")
    n = F.when(F.col("band").isNull(), F.col("n_all")).otherwise(F.coalesce("n", F.lit(0)) + F.coalesce("n_open", F.lit(0)))
    first = F.when(F.col("band").isNull(), F.col("first_all")).otherwise(F.least("first", "first_open"))
    return joined.select("c_custkey", n.alias("n_suppliers"), first.alias("first_supplier")).where("n_suppliers > 0")


def priority_order_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page 3 of 20 orders: by a priority of their own, then the day, then the id."""
    priority = F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", priority.alias("priority"))
    return page(o, ["priority", "o_orderdate", "o_orderkey"], 3, 20)


def important_first(spark: SparkSession, sf: str) -> DataFrame:
    """Within each day, orders over 300,000 first, then by time; the rank is returned."""
    from pyspark.sql import Window as W

    own = W.partitionBy("day").orderBy(F.desc("important"), "o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") > 300000).alias("important"))
    return o.select("o_orderkey", "day", "important", F.row_number().over(own).alias("place"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in several forms, the first form that parses; impossible ones have none."""
    day = F.to_date("o_orderdate")
    form = F.pmod("o_orderkey", F.lit(5))
    written = F.when(form == 0, F.date_format(day, "yyyy-MM-dd")).when(form == 1, F.date_format(day, "yyyy.MM.dd")).when(form == 2, F.date_format(day, "yyyy/MM/dd")).when(form == 3, F.date_format(day, "yyyyMMdd")).otherwise(F.lit("2026-13-45"))
    return table(spark, sf, "orders").select("o_orderkey", written.alias("written")).select("o_orderkey", "written", times.first_date(F.col("written")).alias("parsed"))


def span_parse(spark: SparkSession, sf: str) -> DataFrame:
    """'3/2 ~ 3/9' spans and times within a text: start, end (exclusive, the next day) and a deadline a minute on."""
    a = F.to_date("l_shipdate")
    text = F.concat(F.month(a), F.lit("/"), F.dayofmonth(a), F.lit(" ~ "), F.month(F.date_add(a, 5)), F.lit("/"), F.dayofmonth(F.date_add(a, 5)), F.lit(" 18:30"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("line"))
    part = lambda i: F.regexp_extract("line", r"(\d+)/(\d+) ~ (\d+)/(\d+) (\d+):(\d+)", i).cast("int")
    date = lambda m, d: F.try_to_date(F.concat_ws("-", F.lit("2024"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    low, high = date(part(1), part(2)), date(part(3), part(4))
    return lines.select("l_orderkey", "l_linenumber", low.alias("start_day"), F.date_add(F.when(high < low, low).otherwise(high), 1).alias("end_day"), (part(5) * 60 + part(6) + 1).alias("deadline_minute"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_overlap_incl, interval_overlap_excl, active_or_future, override_coalesce, hidden_anti, calendar_bounds, day_badges, weekday_series, consecutive_runs, visibility_case,
        audience_match, priority_order_page, important_first, text_dates, span_parse,
    )
}

_OCCURS = "((start_at <= TIMESTAMP '{hi}' AND end_at {op} TIMESTAMP '{lo}') OR coalesce(deadline_at BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}', false))"

ORACLES = {
    "interval_overlap_incl": SHIPMENTS + " SELECT o_orderkey, start_at, end_at FROM s WHERE " + _OCCURS.format(lo=LOW, hi=HIGH, op=">="),
    "interval_overlap_excl": SHIPMENTS + " SELECT o_orderkey, start_at, end_at FROM s WHERE " + _OCCURS.format(lo=LOW, hi=HIGH, op=">"),
    "active_or_future": SHIPMENTS + " SELECT o_orderkey, deadline_at, end_at FROM s WHERE coalesce(deadline_at, end_at, start_at) >= TIMESTAMP '1998-06-01'",
    "override_coalesce": SHIPMENTS + f""", k AS (SELECT l_orderkey, CASE WHEN l_quantity > 30 THEN l_shipdate END AS os, CASE WHEN l_linestatus = 'F' THEN 'done' END AS op, l_returnflag = 'R' AS hidden
        FROM lineitem WHERE l_linenumber = 1)
        SELECT o_orderkey, coalesce(os, start_at) AS start_at, end_at, coalesce(op, o_orderpriority) AS o_orderpriority FROM s LEFT JOIN k ON l_orderkey = o_orderkey
        WHERE NOT coalesce(hidden, false) AND coalesce(os, start_at) <= TIMESTAMP '{HIGH}' AND end_at >= TIMESTAMP '{LOW}'""",
    "hidden_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "calendar_bounds": """SELECT day, date_trunc('week', day)::DATE AS week_start, date_trunc('week', day)::DATE + 6 AS week_end, date_trunc('month', day)::DATE AS month_start, last_day(day) AS month_end,
        (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE AS next_start, date_trunc('month', day)::DATE - 1 AS previous_end,
        CASE WHEN day >= m THEN ((day - m) // 7 + 1)::INT END AS week_of_month, (isodow(day) - 1)::INT AS weekday, date_trunc('week', day)::DATE + 2 AS wednesday, day - 365 AS low, day + 365 AS high
        FROM (SELECT DISTINCT o_orderdate::DATE AS day, (date_trunc('month', o_orderdate)::DATE + ((8 - isodow(date_trunc('month', o_orderdate)::DATE)) % 7)::INT) AS m FROM orders)""",
    "day_badges": SHIPMENTS + f""", d AS (SELECT *, deadline_at::DATE - DATE '{NOW}' AS n FROM s WHERE deadline_at IS NOT NULL)
        SELECT o_orderkey, CASE WHEN n = 0 THEN 'D-Day' WHEN n > 0 THEN 'D-' || n ELSE 'D+' || -n END AS badge, greatest(n, 0)::INT AS days_left,
        CASE WHEN n <= 1 THEN 40 WHEN n <= 3 THEN 30 WHEN n <= 7 THEN 20 WHEN n <= 14 THEN 10 ELSE 0 END AS urgency, (end_at::DATE - start_at::DATE) >= 3 AS is_long FROM d""",
    "weekday_series": f"""SELECT o_orderkey, day FROM (SELECT o_orderkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 20, INTERVAL 1 DAY))::DATE AS day FROM orders)
        WHERE isodow(day) < 6 AND (month(day), day(day)) NOT IN ({', '.join(map(str, HOLIDAYS))})""",
    "consecutive_runs": """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'),
        a AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS anchor FROM d),
        r AS (SELECT user_id, day, min(day) OVER w AS island, (count(*) OVER w)::INT AS run_length, (row_number() OVER (PARTITION BY user_id, anchor ORDER BY day))::INT AS run_position FROM a WINDOW w AS (PARTITION BY user_id, anchor))
        SELECT * FROM r WHERE run_length < 4 OR run_position <= 3""",
    "visibility_case": """WITH r AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'always' WHEN k IS NULL THEN 'no metadata' WHEN event_type = 'error' AND k < 30 THEN 'noise'
        WHEN k % 7 = 0 THEN 'source' WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'default' END AS reason FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))
        SELECT event_id, reason, reason IN ('always', 'default') AS visible FROM r""",
    "audience_match": """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 2000) END AS b FROM customer),
        s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal / 2000) END AS b FROM supplier)
        SELECT c_custkey, count(*) AS n_suppliers, min(s_suppkey) AS first_supplier FROM c JOIN s ON c_nationkey = s_nationkey AND (c.b IS NULL OR s.b IS NULL OR c.b = s.b) GROUP BY c_custkey""",
    "priority_order_page": """SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '2-HIGH' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS priority
        FROM orders ORDER BY priority, o_orderdate, o_orderkey LIMIT 20 OFFSET 40""",
    "important_first": """SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice > 300000 AS important,
        (row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_totalprice > 300000 DESC, o_orderdate, o_orderkey))::INT AS place FROM orders""",
    "text_dates": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE '2026-13-45' END AS written, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS parsed FROM orders""",
    "span_parse": """WITH t AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + 5 AS b FROM lineitem),
        u AS (SELECT l_orderkey, l_linenumber, try_cast('2024-' || strftime(a, '%m-%d') AS DATE) AS lo, try_cast('2024-' || strftime(b, '%m-%d') AS DATE) AS hi FROM t)
        SELECT l_orderkey, l_linenumber, lo AS start_day, CASE WHEN hi < lo THEN lo ELSE hi END + 1 AS end_day, 18 * 60 + 31 AS deadline_minute FROM u""",
}
