"""Ranking, deduplication, context windows, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import budgets
from quern.functions.texts import word_tokens
from quern.operators.ranking import first_n_per_key, first_per_key, interleave, spread_rank
from quern.sources.tables import table


def portable_key(*parts):
    """A seeded, engine-independent order: the MD5 of the seed and the id."""
    return F.md5(F.concat_ws("-", *parts))


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return e.select("user_id", "e.*")


def keep_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest order of each customer and day; the others would go."""
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return first_per_key(o, ["o_custkey", "day"], ["o_orderkey"]).select("o_custkey", "day", "o_orderkey")


def keep_best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The line of each order with a return flag, then the highest price, then the longest wait, then the id."""
    best = [F.desc(F.col("l_returnflag") == "R"), F.desc("l_extendedprice"), F.desc("l_shipdate"), "l_linenumber"]
    return first_per_key(table(spark, sf, "lineitem"), ["l_orderkey"], best).select("l_orderkey", "l_linenumber", "l_returnflag")


def nth_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's third largest order; customers with fewer have none."""
    return first_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], rank=3).select("o_custkey", "o_orderkey", "o_totalprice")


def chat_context_prev6(spark: SparkSession, sf: str) -> DataFrame:
    """The six messages before each answer, oldest first."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    c = table(spark, sf, "conversations")
    context = F.collect_list(F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).over(before)
    return c.withColumn("context", F.array_join(context, " / ")).where("role = 'assistant'").select("conv_id", "turn", "context")


def chat_last8(spark: SparkSession, sf: str) -> DataFrame:
    return first_n_per_key(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 8).select("conv_id", "turn", "role")


def chat_latest_message(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max_by("turn", F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"))
    return c.select("conv_id", F.substring("text", 1, 120).alias("preview"), "last_answer")


def chat_session_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Messages and last turn of the 100 sessions with the most recent turns."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("n_user"))
    return c.orderBy(F.desc("last_turn"), "conv_id").limit(100)


def neighbour_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each line that names an item, with the lines before and after it."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = W.partitionBy("doc_id").orderBy("line_no")
    near = lines.select("doc_id", "line_no", "line", F.lag("line").over(own).alias("before"), F.lead("line").over(own).alias("after"))
    return near.where(F.length("line") < 30).select("doc_id", "line_no", "line", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The last signup's and the last purchase's value before each event of a user; a signup resets the latter."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("signup_value", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(own)).withColumn("period", F.count_if(F.col("event_type") == "signup").over(own))
    within = W.partitionBy("user_id", "period").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", "signup_value", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(within).alias("purchase_value"))


def title_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Short lines head sections; each section's lines are counted."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = W.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("section", F.sum((F.length("line") < 40).cast("int")).over(own))
    return marked.groupBy("doc_id", "section").agg(F.min_by("line", "line_no").alias("heading"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of each language goes to the evaluation split: at least one row, at most all but one."""
    d = table(spark, sf, "documents").select("doc_id", "lang", portable_key(F.lit("42"), F.col("doc_id").cast("string")).alias("key"))
    ranked = spread_rank(d, "lang", "key", "doc_id")
    n = F.col("group_size")
    share = F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * 0.1).cast("long"))))
    return ranked.select("doc_id", "lang", F.when(F.col("rank") <= share, "eval").otherwise("train").alias("split"))


def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """150 rows of fixed shares by language; what a language lacks is filled from the others in hash order."""
    quotas = F.create_map(*(F.lit(x) for pair in {"en": 90, "de": 30, "fr": 20, "es": 10}.items() for x in pair))
    d = table(spark, sf, "documents").select("doc_id", "lang", portable_key(F.lit("7"), F.col("doc_id").cast("string")).alias("key"))
    # no row beyond the 150th of its language can be taken
    ranked = first_n_per_key(d, ["lang"], ["key", "doc_id"], 150).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id")))
    turn = F.when(F.col("rank") <= quotas[F.col("lang")], 0).otherwise(1)
    return ranked.orderBy(turn, "key", "doc_id").limit(150).select("doc_id", "lang")


def balanced_upsample(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of rare languages repeated until each has 300, in id order."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    first = first_n_per_key(d, ["lang"], ["doc_id"], 300).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")))
    counted = first.join(d.groupBy("lang").agg(F.count("*").alias("n")), "lang")
    copies = F.floor((F.lit(300) - F.col("rank")) / F.col("n")) + 1
    return counted.select("doc_id", "lang", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))


#: What copies of a row are put between.
OPENINGS, CLOSINGS = ("In short:", "As noted,", "For the record:"), ("That is all.", "More follows.")


def mutated_upsample(spark: SparkSession, sf: str) -> DataFrame:
    """As `balanced_upsample`, each copy rewritten by its number."""
    copies = balanced_upsample(spark, sf).withColumnRenamed("doc_id", "id").select("id", "copy")
    d = table(spark, sf, "documents").join(copies, F.col("doc_id") == F.col("id"))
    text = budgets.rewritten(F.coalesce("text", F.lit("")), F.col("doc_id"), F.col("copy"), OPENINGS, CLOSINGS, 5)
    return d.select("doc_id", "copy", F.md5(text).alias("text_md5"))


def interleave_sources(spark: SparkSession, sf: str) -> DataFrame:
    return interleave(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 130).select("doc_id", "source", "turn")


def representative_title(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest name of each brand, of equally short ones the first."""
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), F.col("p_name"))).alias("title"), F.count_distinct("p_name").alias("n_titles"))
    return p


def recent_prelimit(spark: SparkSession, sf: str) -> DataFrame:
    """Of the 50 newest orders, the three most expensive: the inner limit comes first."""
    newest = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    return newest.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")


def few_shot_select(spark: SparkSession, sf: str) -> DataFrame:
    """The five answers that share most words with a question of three words, ten points each."""
    wanted = F.array(*map(F.lit, ("the", "that", "with")))
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    score = 10 * F.size(F.array_intersect(wanted, F.array_distinct(word_tokens(F.col("text"))))) + F.size(F.array_distinct(word_tokens(F.col("text")))) % 7
    return c.select("conv_id", "turn", score.alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(5)


def centre_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds halfway between neighbouring centres of each brand's sizes; the outermost have the centre."""
    own = W.partitionBy("p_brand").orderBy("p_size")
    s = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    mid = lambda other: (F.col("p_size") + F.coalesce(other, F.col("p_size"))) / 2
    return s.select("p_brand", "p_size", mid(F.lag("p_size").over(own)).alias("low"), mid(F.lead("p_size").over(own)).alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_key, keep_first_per_key, keep_best_per_key, nth_ranked, chat_context_prev6, chat_last8, chat_latest_message, chat_session_stats, neighbour_lines, forward_fill, title_sections,
        stratified_split, quota_sample, balanced_upsample, mutated_upsample, interleave_sources, representative_title, recent_prelimit, few_shot_select, centre_bounds,
    )
}

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"

ORACLES = {
    "latest_per_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "keep_first_per_key": "SELECT o_custkey, o_orderdate::DATE AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
    "keep_best_per_key": """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_extendedprice DESC, l_shipdate DESC, l_linenumber) = 1""",
    "nth_ranked": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 3",
    "chat_context_prev6": """SELECT conv_id, turn, context FROM (SELECT conv_id, turn, role,
        coalesce(string_agg(coalesce(role, '') || ':' || coalesce(text, ''), ' / ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations)
        WHERE role = 'assistant'""",
    "chat_last8": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8",
    "chat_latest_message": """SELECT conv_id, left(arg_max(text, turn), 120) AS preview, max(turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id""",
    "chat_session_stats": """SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 100""",
    "neighbour_lines": f"""WITH n AS (SELECT *, lag(line) OVER w AS b, lead(line) OVER w AS a FROM {LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
        SELECT doc_id, line_no::INT AS line_no, line, coalesce(b, '') AS before, coalesce(a, '') AS after FROM n WHERE length(line) < 30""",
    "forward_fill": """WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS signup_value, count(*) FILTER (event_type = 'signup') OVER w AS period
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, signup_value, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, period ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_value FROM p""",
    "title_sections": f"""WITH m AS (SELECT *, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM {LINES})
        SELECT doc_id, section::BIGINT AS section, arg_min(line, line_no) AS heading, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM m GROUP BY doc_id, section""",
    "stratified_split": """WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM documents)
        SELECT doc_id, lang, CASE WHEN rank <= CASE WHEN n <= 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.1, 0)::BIGINT)) END THEN 'eval' ELSE 'train' END AS split FROM r""",
    "quota_sample": """WITH r AS (SELECT doc_id, lang, md5('7-' || doc_id) AS key, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) AS rank FROM documents),
        q AS (SELECT *, CASE WHEN rank <= CASE lang WHEN 'en' THEN 90 WHEN 'de' THEN 30 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 END THEN 0 ELSE 1 END AS turn FROM r)
        SELECT doc_id, lang FROM q ORDER BY turn, key, doc_id LIMIT 150""",
    "balanced_upsample": """WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
        c AS (SELECT *, greatest(floor((300 - rank) / n) + 1, 0)::BIGINT AS copies FROM r)
        SELECT doc_id, lang, unnest(range(1, copies + 1)) AS copy FROM c""",
    "mutated_upsample": """WITH r AS (SELECT doc_id, lang, coalesce(text, '') AS text, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
        c AS (SELECT doc_id, text, unnest(range(1, greatest(floor((300 - rank) / n) + 1, 0)::BIGINT + 1)) AS copy FROM r), t AS (SELECT *, (doc_id * 7 + 5 + copy - 2) % 6 AS turn, (copy - 2) // 6 AS around FROM c)
        SELECT doc_id, copy, md5(CASE WHEN copy = 1 THEN text ELSE CASE WHEN around > 0 THEN '(' || (around + 1)::BIGINT || ') ' ELSE '' END
            || CASE turn % 3 WHEN 0 THEN 'In short:' WHEN 1 THEN 'As noted,' ELSE 'For the record:' END || ' ' || text || ' ' || CASE WHEN turn < 3 THEN 'That is all.' ELSE 'More follows.' END END) AS text_md5 FROM t""",
    "interleave_sources": """WITH t AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS turn FROM documents) SELECT * FROM t ORDER BY turn, source LIMIT 130""",
    "representative_title": "SELECT p_brand, arg_min(p_name, row(length(p_name), p_name)) AS title, count(DISTINCT p_name) AS n_titles FROM part GROUP BY p_brand",
    "recent_prelimit": """SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) ORDER BY o_totalprice DESC, o_orderkey LIMIT 3""",
    "few_shot_select": f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS w FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, (10 * len(list_intersect(['the', 'that', 'with'], w)) + len(w) % 7)::INT AS score FROM t ORDER BY score DESC, conv_id, turn LIMIT 5""",
    "centre_bounds": """WITH s AS (SELECT DISTINCT p_brand, p_size FROM part)
        SELECT p_brand, p_size, (p_size + coalesce(lag(p_size) OVER w, p_size)) / 2 AS low, (p_size + coalesce(lead(p_size) OVER w, p_size)) / 2 AS high FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
}
