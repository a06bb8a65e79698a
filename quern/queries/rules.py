"""Rule engines: scoring, routing, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import texts
from quern.functions.rules import all_reasons, any_of_groups, clamp, first_rule, points
from quern.sources.tables import table


def recommendation_score(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders scored by importance, urgency and their customer's balance, with reasons; the best five."""
    left = F.datediff(F.to_date("o_orderdate"), F.lit("1998-07-01").cast("date"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").withColumn("days", F.greatest(left, F.lit(0)))
    urgency = first_rule([(F.col("days") <= 1, 40), (F.col("days") <= 3, 30), (F.col("days") <= 7, 20), (F.col("days") <= 14, 10)], 0)
    score = points([(F.col("o_orderpriority").startswith("1"), 30), (F.col("o_orderpriority").startswith("2"), 15), (F.col("c_acctbal") < 0, 25), (F.col("o_totalprice") > 300000, 10), (F.col("days") > 21, -20)]) + urgency
    reasons = all_reasons([(F.col("o_orderpriority").startswith("1"), "important"), (F.col("days") <= 7, "soon"), (F.col("c_acctbal") < 0, "weak")])
    level = first_rule([(F.col("score") >= 70, "DANGER"), (F.col("score") >= 45, "WARNING"), (F.col("score") >= 20, "CAUTION")], "SAFE")
    scored = o.select("o_orderkey", "o_orderdate", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))
    return scored.orderBy(F.desc("score"), "o_orderdate", "o_orderkey").limit(5).select("o_orderkey", "score", "reasons", level.alias("level"))


def route_stage(spark: SparkSession, sf: str) -> DataFrame:
    """The first stage that fits each run, what it used, and who wrote the end."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    stage = first_rule([(F.col("event_type") == "error", "failed"), (F.col("k") < 10, "cache"), ((F.col("event_type") == "view") & (F.col("k") < 50), "database"), (F.col("event_type").isin("click", "view"), "search"), (F.col("value") > 50, "model")], "fallback")
    staged = e.select("event_id", "event_type", stage.alias("stage"))
    return staged.select("event_id", "stage", F.col("stage").isin("search", "model").alias("used_rag"), (F.col("stage") == "database").alias("used_db"), first_rule([(F.col("stage").isin("model", "search"), "model"), (F.col("stage") == "failed", "none")], "template").alias("generator"))


def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """A run's quality: a base by its kind (error, no context, fallback, plain), less what was not found, substituted,
    slow or too short, between 0 and 1. Runs are events: their number tells the policy, their value the latency."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    policy = F.element_at(F.array(*map(F.lit, ("DIRECT", "RAG_FALLBACK", "NO_CONTEXT", "SCHEDULE_DB_DIRECT", "NO_EXACT_MATCH", "RAG"))), (n % 6 + 1).cast("int"))
    run = table(spark, sf, "events").select("event_id", policy.alias("policy"), ((F.col("event_type") == "error") | (policy == "ERROR")).alias("is_error"), F.coalesce(k % 4, F.lit(0)).alias("retrieved"), F.coalesce(k % 3, F.lit(0)).alias("fallbacks"), F.coalesce(k % 5, F.lit(0)).alias("references"), (F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("latency"), F.col("event_type").alias("answer"))
    lacks, falls = F.col("policy").rlike("NO_CONTEXT|NO_MATCH|NO_EXACT_MATCH"), F.col("policy").contains("FALLBACK")
    base = first_rule([(F.col("is_error"), 0.1), (lacks, 0.45), (falls, 0.65)], 1.0)
    nothing = (F.col("retrieved") == 0) & (F.col("references") == 0) & ~F.col("policy").contains("SCHEDULE_DB_DIRECT")
    less = points([(nothing, 0.15), (F.col("fallbacks") > 0, 0.1), (F.length(F.trim("answer")) < 6, 0.1)]) + first_rule([(F.col("latency") >= 20000, 0.2), (F.col("latency") >= 10000, 0.1)], 0.0)
    score = clamp(F.round(base - F.when(F.col("is_error") | lacks, 0.0).otherwise(less), 3), 0.0, 1.0)
    return run.select("event_id", score.alias("score"), falls.alias("is_fallback"), lacks.alias("is_no_context"))


def query_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of a user's message by ordered patterns, its rule confidence and band."""
    t = F.lower(F.coalesce("text", F.lit("")))
    kind = first_rule([(t.rlike(r"\b(when|date|day|week)\b"), "schedule"), (t.rlike(r"\b(rule|must|may)\b"), "rule"), (t.contains("?"), "question"), (F.length(t) < 20, "small talk")], "general")
    confidence = F.create_map(*(F.lit(x) for pair in {"schedule": 0.9, "rule": 0.8, "question": 0.6, "small talk": 0.4, "general": 0.2}.items() for x in pair))[F.col("kind")]
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("kind"))
    return c.select("conv_id", "turn", "kind", confidence.alias("confidence"), first_rule([(confidence >= 0.75, "high"), (confidence >= 0.45, "middle")], "low").alias("band"))


def constraint_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Include filters as groups of which one each must hold, and exclude filters."""
    p = table(spark, sf, "part")
    groups = [[F.col("p_type").contains("PROMO"), F.col("p_type").contains("SMALL")], [F.col("p_size") < 20, F.col("p_brand").endswith("3")]]
    return p.where(any_of_groups(groups) & ~F.col("p_name").rlike("red|blue")).select("p_partkey", "p_type", "p_size")


def answer_policy(spark: SparkSession, sf: str) -> DataFrame:
    """For each session what may be answered: by what its messages hold."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n_system"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(F.length("text")).alias("longest"))
    policy = first_rule([(F.col("n_user") == 0, "no_question"), (F.col("n_system") > 0, "guided"), (F.col("longest") > 600, "retrieve"), (F.col("n_user") > 3, "follow_up")], "direct")
    return c.select("conv_id", policy.alias("policy"), policy.isin("guided", "retrieve").alias("use_references"))


def rubric_score(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by five parts: length, structure, overlap with the question, tone and safety; with issues."""
    from pyspark.sql import Window as W

    own = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("asked", F.coalesce(F.lag("text").over(own), F.lit(""))).where("role = 'assistant'").withColumn("t", F.coalesce("text", F.lit("")))
    words, asked = F.array_distinct(texts.word_tokens(F.col("t"))), F.array_distinct(texts.word_tokens(F.col("asked")))
    measured = c.select("conv_id", "turn", "t", F.size(words).alias("n"), F.size(F.array_intersect(words, asked)).alias("hits"), F.size(asked).alias("m"))
    length, shape = clamp(F.col("n") / 4, 7.0, 20.0), points([(F.col("t").contains("\n"), 10), (F.col("t").contains("."), 5)])
    overlap = F.least(F.lit(40.0), 40 * F.coalesce(F.try_divide(F.col("hits"), F.col("m")), F.lit(0.0)))
    score = F.round(length + shape + overlap + F.when(F.col("t").rlike("(?i)please|thank"), 10).otherwise(4) + F.when(F.col("t").rlike("(?i)idiot|stupid"), 0).otherwise(15), 4)
    issues = all_reasons([(F.col("n") == 0, "empty"), (F.col("n") > 150, "long"), (F.col("hits") == 0, "off topic")])
    return measured.select("conv_id", "turn", score.alias("score"), F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("passed"))


def retrieval_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by source rule and category: the mapped host class, else a word of the path, else unknown."""
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    mapped = F.create_map(*(F.lit(x) for pair in {"www": "official", "blog": "community", "m": "mobile"}.items() for x in pair))[F.substring_index(host, ".", 1)]
    word = first_rule([(F.col("url").contains("/en/"), "english"), (F.col("url").contains("/de/"), "german")], None)
    return table(spark, sf, "pages").select("page_id", F.coalesce(mapped, word.cast("string"), F.lit("unknown")).alias("category"))


QUERIES = {f.__name__: f for f in (recommendation_score, route_stage, quality_score, query_classifier, constraint_filters, answer_policy, rubric_score, retrieval_policy)}

ORACLES = {
    "recommendation_score": """WITH o AS (SELECT *, greatest(o_orderdate::DATE - DATE '1998-07-01', 0) AS days FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'),
        s AS (SELECT o_orderkey, o_orderdate, (CASE WHEN starts_with(o_orderpriority, '1') THEN 30 ELSE 0 END + CASE WHEN starts_with(o_orderpriority, '2') THEN 15 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 25 ELSE 0 END
            + CASE WHEN o_totalprice > 300000 THEN 10 ELSE 0 END + CASE WHEN days > 21 THEN -20 ELSE 0 END + CASE WHEN days <= 1 THEN 40 WHEN days <= 3 THEN 30 WHEN days <= 7 THEN 20 WHEN days <= 14 THEN 10 ELSE 0 END) AS score,
            array_to_string(list_filter([CASE WHEN starts_with(o_orderpriority, '1') THEN 'important' END, CASE WHEN days <= 7 THEN 'soon' END, CASE WHEN c_acctbal < 0 THEN 'weak' END], lambda r: r IS NOT NULL), ',') AS reasons FROM o)
        SELECT o_orderkey, score, reasons, CASE WHEN score >= 70 THEN 'DANGER' WHEN score >= 45 THEN 'WARNING' WHEN score >= 20 THEN 'CAUTION' ELSE 'SAFE' END AS level FROM s ORDER BY score DESC, o_orderdate, o_orderkey LIMIT 5""",
    "route_stage": """WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN (props->>'$.k')::INT < 10 THEN 'cache' WHEN event_type = 'view' AND (props->>'$.k')::INT < 50 THEN 'database'
        WHEN event_type IN ('click', 'view') THEN 'search' WHEN value > 50 THEN 'model' ELSE 'fallback' END AS stage FROM events)
        SELECT event_id, stage, stage IN ('search', 'model') AS used_rag, stage = 'database' AS used_db, CASE WHEN stage IN ('model', 'search') THEN 'model' WHEN stage = 'failed' THEN 'none' ELSE 'template' END AS generator FROM s""",
    "quality_score": """WITH e AS (SELECT *, (props->>'$.k')::INT AS k, ['DIRECT', 'RAG_FALLBACK', 'NO_CONTEXT', 'SCHEDULE_DB_DIRECT', 'NO_EXACT_MATCH', 'RAG'][event_id % 6 + 1] AS policy FROM events),
        r AS (SELECT event_id, policy, event_type, event_type = 'error' AS is_error, contains(policy, 'FALLBACK') AS falls, regexp_matches(policy, 'NO_CONTEXT|NO_MATCH|NO_EXACT_MATCH') AS lacks, coalesce(k % 4, 0) = 0 AND coalesce(k % 5, 0) = 0 AND policy <> 'SCHEDULE_DB_DIRECT' AS nothing,
            coalesce(k % 3, 0) > 0 AS other, trunc(coalesce(value, 0) * 100) AS latency FROM e)
        SELECT event_id, greatest(0.0, least(1.0, round(CASE WHEN is_error THEN 0.1 WHEN lacks THEN 0.45 WHEN falls THEN 0.65 ELSE 1.0 END::DOUBLE - CASE WHEN is_error OR lacks THEN 0.0 ELSE CASE WHEN nothing THEN 0.15 ELSE 0 END + CASE WHEN other THEN 0.1 ELSE 0 END
            + CASE WHEN length(event_type) < 6 THEN 0.1 ELSE 0 END + CASE WHEN latency >= 20000 THEN 0.2 WHEN latency >= 10000 THEN 0.1 ELSE 0 END END::DOUBLE, 3)))::DOUBLE AS score, falls AS is_fallback, lacks AS is_no_context FROM r""",
    "query_classifier": r"""WITH k AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b(when|date|day|week)\b') THEN 'schedule' WHEN regexp_matches(t, '\b(rule|must|may)\b') THEN 'rule' WHEN contains(t, '?') THEN 'question'
            WHEN length(t) < 20 THEN 'small talk' ELSE 'general' END AS kind FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user')),
        c AS (SELECT *, CASE kind WHEN 'schedule' THEN 0.9 WHEN 'rule' THEN 0.8 WHEN 'question' THEN 0.6 WHEN 'small talk' THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence FROM k)
        SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'middle' ELSE 'low' END AS band FROM c""",
    "constraint_filters": """SELECT p_partkey, p_type, p_size FROM part WHERE (contains(p_type, 'PROMO') OR contains(p_type, 'SMALL')) AND (p_size < 20 OR ends_with(p_brand, '3')) AND NOT regexp_matches(p_name, 'red|blue')""",
    "answer_policy": """WITH p AS (SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no_question' WHEN count(*) FILTER (role = 'system') > 0 THEN 'guided' WHEN max(length(text)) > 600 THEN 'retrieve'
        WHEN count(*) FILTER (role = 'user') > 3 THEN 'follow_up' ELSE 'direct' END AS policy FROM conversations GROUP BY conv_id) SELECT *, policy IN ('guided', 'retrieve') AS use_references FROM p""",
    "rubric_score": r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS asked FROM conversations),
        w AS (SELECT conv_id, turn, t, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(asked), '[\p{L}\p{N}_]+')) AS b FROM c WHERE role = 'assistant'),
        m AS (SELECT conv_id, turn, t, len(a) AS n, len(list_intersect(a, b)) AS hits, len(b) AS m FROM w),
        i AS (SELECT *, list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 150 THEN 'long' END, CASE WHEN hits = 0 THEN 'off topic' END], lambda r: r IS NOT NULL) AS issues FROM m)
        SELECT conv_id, turn, round(greatest(7.0, least(20.0, n / 4)) + CASE WHEN contains(t, chr(10)) THEN 10 ELSE 0 END + CASE WHEN contains(t, '.') THEN 5 ELSE 0 END + least(40.0, 40 * coalesce(hits / nullif(m, 0), 0.0))
        + CASE WHEN regexp_matches(t, '(?i)please|thank') THEN 10 ELSE 4 END + CASE WHEN regexp_matches(t, '(?i)idiot|stupid') THEN 0 ELSE 15 END, 4) AS score, array_to_string(issues, ',') AS issues, len(issues) = 0 AS passed FROM i""",
    "retrieval_policy": r"""SELECT page_id, coalesce(CASE split_part(regexp_extract(url, '://([^/?#]+)', 1), '.', 1) WHEN 'www' THEN 'official' WHEN 'blog' THEN 'community' WHEN 'm' THEN 'mobile' END,
        CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' END, 'unknown') AS category FROM pages""",
}
