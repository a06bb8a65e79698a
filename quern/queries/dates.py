"""Dates in texts, moving holidays, and what lies above a box on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import moving_days, spans
from quern.operators import grid, merge
from quern.sources.tables import table

#: The year of dates that name none.
YEAR = 2026


def spans_of_lines(lines: DataFrame, *key: str) -> DataFrame:
    """(key…, start, length, first, last, start_at, end_at, all_day) of all dates and ranges of dates in lines (key…, line). Only lines with a
    digit are read by the scanner, and those of one text once."""
    # the scanner's work is in lines, not in bytes, by which small partitions would be put together
    own = lines.where(F.col("line").rlike("[0-9]")).select("line").distinct().repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line")
    read = spans.with_spans(own, "line")
    # explode would have Spark ask for filled spans before lines are made distinct; lines without a span have no days and go with those
    each = read.select("line", spans.without_spans(F.col("line")).alias("rest"), F.explode_outer("spans").alias("s")).select("line", "rest", "s.*")
    when = spans.with_moments(spans.with_days(each, YEAR), "rest").select("line", "start", "length", "first", "last", "start_at", "end_at", "all_day")
    return lines.join(when, "line").select(*key, "start", "length", "first", "last", "start_at", "end_at", "all_day")


def shipping_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines told in words, in four forms by their number, and the days and times that are read back from them."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))
    form = lambda add, pattern: F.date_format(F.date_add("day", add), pattern)
    told = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("ships "), form(0, "yyyy.M.d"), F.lit(" from the store")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(form(0, "yyyy-MM-dd"), F.lit(" ~ "), form(3, "yyyy-MM-dd"), F.lit(", shop closed")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(form(0, "yyyy년 M월 d일"), F.lit(" 14:05 due")))
        .otherwise(F.concat(form(0, "yyyy/MM/dd"), F.lit(" 9:00~11:30 or "), form(1, "yyyy/M/d")))
    )
    return spans_of_lines(line.select("l_orderkey", "l_linenumber", "l_partkey", told.alias("line")), "l_orderkey", "l_linenumber", "l_partkey")


def holiday_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on public holidays, by holiday. The holidays are those of the years of the orders, some twenty a year."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    low, high = days.agg(F.min(F.year("day")), F.max(F.year("day"))).first()
    rows = [(d, name) for year in range(low, high + 1) for d, name in moving_days.holidays(year).items()] if low else []
    names = spark.createDataFrame(rows, "day date, holiday string")
    return days.join(F.broadcast(names), "day").groupBy("day", "holiday").agg(F.count("*").alias("n"))


def nearest_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as boxes on their supplier's page, and parts as its cells in five columns: the cell above each box."""
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("page"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("box_no"), (F.col("l_discount") * 1000).alias("cx"), (F.col("l_extendedprice") / 50).alias("cy"))
    part = table(spark, sf, "part").select((F.floor(F.col("p_partkey") / 20) + 1).alias("page"), F.col("p_partkey").cast("long").alias("cell_no"), (F.col("p_size") % 5).alias("column_no"), F.col("p_retailprice").alias("y1"))
    cells = part.withColumn("x1", F.col("column_no") * 25.0).withColumn("x2", F.col("x1") + 24)
    return grid.cell_above(line, cells)


def reimport_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an import of the pages again would do: some come as they were but for white space and order in their details
    or a recognised section, some changed, some are new."""
    p = table(spark, sf, "pages")
    details = lambda form: F.format_string(form, "page_id")
    old = p.where("page_id % 7 <> 6").select("page_id", F.struct("url", "html", details('{"id": %d, "seen": [1, 2]}').alias("details")).alias("old"))
    kind = F.col("page_id") % 7
    html = F.when(kind == 1, F.concat("html", F.lit("\n[recognised]\nletters"))).when(kind == 2, F.concat(F.lit("new "), "html")).otherwise(F.col("html"))
    own = F.when(kind == 3, details('{ "seen":[1,2],  "id":%d }')).when(kind == 4, details('{"id": %d, "seen": [2, 1]}')).otherwise(details('{"id": %d, "seen": [1, 2]}'))
    new = p.select("page_id", F.struct(F.when(kind == 5, None).otherwise(F.col("url")).alias("url"), html.alias("html"), own.alias("details")).alias("new"))
    changed = merge.differs(F.col("old"), F.col("new"), ["url", "html", "details"], json=["details"], marked=["html"], mark="[recognised]")
    return old.join(new, "page_id", "full").select("page_id", F.when(F.col("old").isNull(), "insert").when(changed, "update").otherwise("skip").alias("change"))


QUERIES = {f.__name__: f for f in (shipping_spans, holiday_orders, nearest_cell, reimport_changes)}
# The lunar dates are written out by hand.
ORACLES = {
    "shipping_spans": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 AS form, l_shipdate::DATE AS day FROM lineitem),
        s AS (SELECT *, CASE form WHEN 0 THEN 6 ELSE 0 END AS start,
            CASE form WHEN 0 THEN length(strftime(day, '%Y.%-m.%-d')) WHEN 1 THEN 23 WHEN 2 THEN length(strftime(day, '%Y %-m %-d')) + 3 ELSE 10 END AS length,
            day AS first, CASE form WHEN 1 THEN day + 3 ELSE day END AS last FROM l
            UNION ALL SELECT *, 25, length(strftime(day + 1, '%Y/%-m/%-d')), day + 1, day + 1 FROM l WHERE form = 3)
        SELECT l_orderkey, l_linenumber, l_partkey, start, length, first, last, first + CASE form WHEN 2 THEN INTERVAL 845 MINUTE WHEN 3 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS start_at,
        last + CASE form WHEN 2 THEN INTERVAL 846 MINUTE WHEN 3 THEN INTERVAL 690 MINUTE ELSE INTERVAL 1 DAY END AS end_at, form < 2 AS all_day FROM s""",
    "holiday_orders": """WITH h(day, holiday) AS (
            SELECT m::DATE + n, 'lunar new year' FROM (VALUES ('1992-02-04'), ('1993-01-23'), ('1994-02-10'), ('1995-01-31'), ('1996-02-19'), ('1997-02-08'), ('1998-01-28'), ('1999-02-16'), ('2000-02-05'), ('2001-01-24')) t(m), (VALUES (-1), (0), (1)) u(n)
            UNION ALL SELECT m::DATE + n, 'harvest' FROM (VALUES ('1992-09-11'), ('1993-09-30'), ('1994-09-20'), ('1995-09-09'), ('1996-09-27'), ('1997-09-16'), ('1998-10-05'), ('1999-09-24'), ('2000-09-12'), ('2001-10-01')) t(m), (VALUES (-1), (0), (1)) u(n)
            UNION ALL SELECT m::DATE, 'buddha' FROM (VALUES ('1992-05-10'), ('1993-05-28'), ('1994-05-18'), ('1995-05-07'), ('1996-05-24'), ('1997-05-14'), ('1998-05-03'), ('1999-05-22'), ('2000-05-11'), ('2001-05-01')) t(m)
            UNION ALL SELECT make_date(y, m, d), name FROM range(1992, 2002) r(y), (VALUES (1, 1, 'new year'), (3, 1, 'independence movement'), (5, 5, 'children'), (6, 6, 'memorial'), (8, 15, 'liberation'), (10, 3, 'foundation'), (12, 25, 'christmas')) t(m, d, name))
        SELECT o_orderdate::DATE AS day, holiday, count(*) AS n FROM orders JOIN h ON o_orderdate::DATE = h.day GROUP BY ALL""",
    "nearest_cell": """WITH b AS (SELECT l_suppkey::BIGINT AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS box_no, l_discount * 1000 AS cx, l_extendedprice / 50 AS cy FROM lineitem),
        c AS (SELECT p_partkey // 20 + 1 AS page, p_partkey::BIGINT AS cell_no, p_size % 5 AS column_no, p_retailprice AS y1 FROM part),
        k AS (SELECT DISTINCT page, column_no FROM c), o AS (SELECT page, column_no, y1, min(cell_no) AS cell_no FROM c GROUP BY ALL),
        m AS (SELECT b.page, box_no, cy, column_no FROM b JOIN k ON b.page = k.page AND cx >= column_no * 25.0::DOUBLE AND cx <= column_no * 25.0::DOUBLE + 24)
        SELECT m.page, m.box_no, o.cell_no FROM m ASOF JOIN o ON m.page = o.page AND m.column_no = o.column_no AND m.cy >= o.y1""",
    "reimport_changes": "SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'insert' WHEN page_id % 7 IN (2, 4, 5) THEN 'update' ELSE 'skip' END AS change FROM pages",
}
