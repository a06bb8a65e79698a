"""Runs and their policies: routes, metrics, answer and retrieval policies, filters by name, ranges, pages, rubric.

Runs are events: number and JSON value of an event pick its policy, mode, references and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import texts
from quern.functions.rules import all_reasons, first_rule, points
from quern.operators.ranking import first_n_per_key
from quern.queries import planning, questions
from quern.sources.tables import table

# Policies, modes, stages and word tables of the surveyed rules.
POLICIES = (
    "ERROR", "DISABLED", "PERSONAL_CONTEXT_LORA", "LORA_REASONER", "LLM_INTENT_SCHEDULE_DB", "SERVER_VERIFIED_RAG", "SCHEDULE_MEMORY_HIT", "SCHEDULE_DB_DIRECT", "PERSONAL_CONTEXT_LLM",
    "PERSONAL_CONTEXT_SCORE", "RAG_GROUNDED", "OFFICIAL_NO_CONTEXT", "GENERAL_KNOWLEDGE_FALLBACK", "CAUTIOUS_FALLBACK", "OTHER",
)
MODES = ("", "", "", "", "", "", "model_error", "ai_server_down", "lora_reasoner", "personal_context_lora", "schedule_memory", "schedule_db_direct", "personal_context_llm", "official_no_context")
STORED, FALLBACKS = ("db", "llm_intent_db", "personal_db", "personal_db_llm", "personal_db_lora"), ("GENERAL_KNOWLEDGE_FALLBACK", "GENERAL_ADVICE_FALLBACK", "CAUTIOUS_FALLBACK")
OTHER_TYPES = ("study", "assignment", "lecture", "deadline", "notice", "generated", "evaluation", "learning", "mentoring", "unknown", "other", "etc", "기타")
EXAM_WORDS, DEADLINE_WORDS = ("평가", "시험", "과목평가", "월말평가"), ("마감", "제출", "과제")
KINDS = ("OFFICIAL", "GENERAL_TECH", "GENERAL_ADVICE", "OTHER")
ANSWERS = (("OFFICIAL", "OFFICIAL_NO_CONTEXT", False), ("GENERAL_TECH", "GENERAL_KNOWLEDGE_FALLBACK", True), ("GENERAL_ADVICE", "GENERAL_ADVICE_FALLBACK", True))
PRIORITY = ("우선", "먼저", "1.", "2.", "3.", "순위", "중요", "집중", "줄이", "나누", "균형", "확인", "공유", "조율", "결정", "선택", "현실적", "최소", "핵심")
DOMAIN = ("과락", "월말", "평가", "프로젝트", "팀원", "팀", "발표", "프로님", "멘토", "멘토링", "시험", "알고리즘", "출결", "지각", "수료", "공지", "관통", "git", "github", "mattermost")
ACTIONS = ("확인", "공유", "정리", "나누", "조율", "줄이", "집중", "요청", "상담", "준비", "체크", "기록", "말해", "물어", "계획", "시작", "정하", "작성", "연락", "복습", "테스트", "수정")
ASK_STOPS = ("어떻게", "하시겠습니까", "좋을까요", "무엇부터", "해야", "하나요", "할까요")
TOKEN_STOPS = ("것", "수", "있", "합니다", "하세요", "좋습니다", "먼저", "그리고", "하지만", "때문", "대한", "현재", "상황", "정도", "경우", "일반적으로", "입니다")


def _pick(parts, number, step=1):
    return F.element_at(F.array(*map(F.lit, parts)), (F.floor(number / step) % len(parts) + 1).cast("int"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("event_id"), F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(spark, sf, "events").select("event_id", "user_id", "ts", _pick(POLICIES, n).alias("policy"), _pick(MODES, n, 7).alias("mode"), (k % 5 == 0).alias("cited"), F.when(k % 3 == 0, (F.col("value") * 10).cast("int")).alias("tokens"))


def routed(run: DataFrame) -> DataFrame:
    """``run`` (policy, mode, cited, tokens) with its stage, what it used, whether a model was needed and who wrote the end."""
    p, m = F.col("policy"), F.col("mode")
    stage = first_rule(
        [
            ((p == "ERROR") | m.endswith("_error") | m.startswith("ai_server_"), "error"),
            (p == "DISABLED", "disabled"),
            ((p == "PERSONAL_CONTEXT_LORA") | (m == "personal_context_lora"), "personal_db_lora"),
            ((p == "LORA_REASONER") | (m == "lora_reasoner"), "lora"),
            (p.rlike("^(?:LLM_INTENT_|SERVER_VERIFIED_)") & p.contains("SCHEDULE_DB"), "llm_intent_db"),
            (p.rlike("^(?:LLM_INTENT_|SERVER_VERIFIED_)"), "llm_intent"),
            (p.rlike("^SCHEDULE_(?:MEMORY|DB)") | m.isin("schedule_memory", "schedule_db_direct"), "db"),
            ((p == "PERSONAL_CONTEXT_LLM") | (m == "personal_context_llm"), "personal_db_llm"),
            (p.startswith("PERSONAL_CONTEXT"), "personal_db"),
            ((p == "RAG_GROUNDED") | F.col("cited"), "rag_llm"),
            ((p == "OFFICIAL_NO_CONTEXT") | (m == "official_no_context"), "rag"),
            (p.isin(*FALLBACKS), "llm"),
        ],
        "unknown",
    )
    s = F.col("stage")
    staged = run.withColumn("stage", stage)
    intent = p.rlike("^(?:LLM_INTENT_|SERVER_VERIFIED_)")
    lora = (s == "lora") | m.isin("lora_reasoner", "personal_context_lora") | p.isin("LORA_REASONER", "PERSONAL_CONTEXT_LORA")
    used = staged.withColumn("used_db", s.isin(*STORED)).withColumn("used_lora", lora).withColumn("used_intent", intent)
    used = used.withColumn("used_rag", s.isin("rag", "rag_llm") | (p == "RAG_GROUNDED") | (F.col("cited") & ~F.col("used_db")))
    used = used.withColumn("used_llm", F.col("used_lora") | F.col("used_intent") | s.isin("llm", "rag_llm", "personal_db_llm") | (F.coalesce("tokens", F.lit(0)) > 0))
    db, rag, llm = F.col("used_db"), F.col("used_rag"), F.col("used_llm")
    writer = first_rule(
        [(F.col("used_lora"), "lora"), (s.isin("db", "llm_intent_db", "personal_db") & ~llm, "server_db_formatter"), (rag & llm, "rag_plus_llm"), (db & llm, "db_plus_llm"), (llm, "llm"), (rag, "rag_no_context"), (db, "server_db_formatter")], s
    )
    return used.withColumn("converted", llm & ~s.isin("db", "personal_db")).withColumn("generator", writer)


def run_routes(spark: SparkSession, sf: str) -> DataFrame:
    return routed(runs(spark, sf)).select("event_id", "stage", "used_db", "used_rag", "used_llm", "used_lora", "used_intent", "converted", "generator")


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Of each day's runs how many used what, in per cent, their mean tokens and their most frequent stage."""
    r = routed(runs(spark, sf)).withColumn("day", F.to_date("ts"))
    share = lambda c: F.round(100 * F.count_if(F.col(c)) / F.count("*"), 1).alias(f"{c}_pct")
    used = ("used_db", "used_rag", "used_llm", "used_intent", "converted")
    totals = r.groupBy("day").agg(F.count("*").alias("n"), *map(share, used), F.coalesce(F.round(F.avg("tokens"), 1), F.lit(0.0)).alias("avg_tokens"))
    stages = r.groupBy("day", "stage").agg(F.count("*").alias("n_stage")).groupBy("day").agg(F.max_by("stage", F.struct("n_stage", "stage")).alias("top_stage"))
    return totals.join(stages, "day")


def answer_policies(spark: SparkSession, sf: str) -> DataFrame:
    """What may be answered by the kind of question and whether what was found suffices."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    e = table(spark, sf, "events").select("event_id", _pick(KINDS, F.col("event_id")).alias("kind"), (k % 3 > 0).alias("lacking"))
    of = lambda name, llm, cite: F.struct(F.lit(name).alias("policy"), F.lit(llm).alias("use_llm"), F.lit(cite).alias("use_references"))
    rules = [(~F.col("lacking"), of("RAG_GROUNDED", True, True)), *((F.col("kind") == kind, of(policy, llm, False)) for kind, policy, llm in ANSWERS)]
    return e.withColumn("p", first_rule(rules, of("CAUTIOUS_FALLBACK", True, False))).select("event_id", "p.*")


def retrieval_policies(spark: SparkSession, sf: str) -> DataFrame:
    """How a parsed question is looked up."""
    kind = F.col("p.query_type")
    name = first_rule([(kind == "SCHEDULE_EXACT_DATE", "SCHEDULE_METADATA_EXACT"), (kind.isin("SCHEDULE_MONTH", "SCHEDULE_RANGE"), "SCHEDULE_METADATA_RANGE")], "SEMANTIC_RETRIEVAL")
    q = questions.parsed(spark, sf).select("event_id", name.alias("name"))
    return q.select("event_id", "name", F.col("name").startswith("SCHEDULE").alias("use_metadata"), (F.col("name") == "SEMANTIC_RETRIEVAL").alias("allow_fallback"), F.col("name").endswith("EXACT").alias("exact"))


def evaluation_risk(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's risk by passed, failed and open lines of ten planned ones, of which six must pass and four may fail."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))  # noqa: E741
    counted = l.select("l_suppkey", (F.col("n") % 8).alias("passed"), (F.col("r") % 6).alias("failed"))
    p, f = F.col("passed"), F.col("failed")
    left, half = F.greatest(F.lit(0), 10 - p - f), p + F.greatest(F.lit(0), 10 - p - f) / 2
    level = first_rule(
        [(p >= 6, "SAFE"), ((left <= 0) | (6 - p > left), "DANGER"), (p + f <= 0, "CAUTION"), ((4 - f <= 0) | (half < 6), "WARNING"), (half == 6, "CAUTION"), ((half >= 7) & (4 - f >= 2), "SAFE")], "CAUTION"
    )
    return counted.select("l_suppkey", "passed", "failed", level.alias("level"))


#: Filters by name: what an event of type, title and owner must be.
FILTERS = ("exam", "subject_exam", "monthly_exam", "deadline", "assignment", "project", "personal", "public", "holiday", "notice", "study", "online_week", "important", "unheard")


def named_filter(name: str) -> F.Column:
    """The predicate of a filter's name over type, title, owner_id and important; none holds for an unknown name."""
    kind, title, own = F.col("type"), F.lower("title"), F.col("owner_id").isNotNull()
    text = F.concat_ws(" ", title, kind)
    has = planning.has
    table_of = {
        "exam": (kind == "exam") | has(text, EXAM_WORDS), "subject_exam": (kind == "exam") & text.contains("과목평가"), "monthly_exam": (kind == "exam") & text.contains("월말평가"),
        "deadline": kind.isin("deadline", "assignment") | has(text, DEADLINE_WORDS), "assignment": kind.isin("deadline", "assignment") | has(text, DEADLINE_WORDS),
        "project": (kind == "project") | text.contains("프로젝트"), "personal": own | (kind == "personal"), "public": ~own, "holiday": kind == "holiday", "notice": kind == "notice",
        "study": kind == "study", "online_week": has(text, ("온라인위크", "온라인 위크")), "important": F.col("important"),
    }
    return F.coalesce(table_of.get(name, F.lit(False)), F.lit(False))


def filter_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """For each filter's name the events that it takes: how many, and the first and last."""
    e = planning.planned(spark, sf).withColumn("type", first_rule([(planning.has(F.col("title"), words), name) for words, name in planning.TYPES], "notice"))
    marked = e.select("event_id", F.explode(F.array_compact(F.array(*(F.when(named_filter(n), F.lit(n)) for n in FILTERS)))).alias("filter"))
    return marked.groupBy("filter").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def other_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the group that is asked for: each asks for its user's kind, 'other' standing for thirteen types."""
    e = planning.planned(spark, sf).select("event_id", first_rule([(planning.has(F.col("title"), words), name) for words, name in planning.TYPES], "notice").alias("type"), _pick(("other", "exam", "project", " exam "), F.col("event_id"), 3).alias("asked"))
    wanted = F.trim("asked")
    return e.where(F.when(wanted == "other", F.col("type").isin(*OTHER_TYPES)).otherwise(F.col("type") == wanted)).select("event_id", "type")


def few_shot_examples(spark: SparkSession, sf: str) -> DataFrame:
    """For every item the two examples (the first twenty messages) that suit it best: ten for each keyword in it, one for
    each shared word; the first two where none suits."""
    examples = table(spark, sf, "conversations").where("role = 'user'").orderBy("conv_id", "turn").limit(20).select((F.col("conv_id") * 1000 + F.col("turn")).alias("example"), F.array_distinct(texts.word_tokens(F.coalesce("text", F.lit("")))).alias("words"))
    examples = examples.withColumn("keys", F.slice("words", 1, 3)).withColumn("place", F.row_number().over(W.orderBy("example")))  # of twenty rows
    items = table(spark, sf, "benchmark").select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.array_distinct(texts.word_tokens(F.coalesce("text", F.lit("")))).alias("own"))
    score = 10 * F.size(F.filter("keys", lambda k: F.contains(F.col("low"), k))) + F.size(F.array_intersect("own", "words"))
    scored = items.join(F.broadcast(examples)).select("item_id", "example", "place", score.alias("score"))  # twenty rows
    best = scored.withColumn("most", F.max("score").over(W.partitionBy("item_id")))
    fits = best.where((F.col("score") > 0) | ((F.col("most") <= 0) & (F.col("place") <= 2)))
    return first_n_per_key(fits, ["item_id"], [F.desc("score"), "place"], 2).select("item_id", "example", "score")


def numbered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of twenty events by time, as JSON with its number, size and the count of all."""
    e = table(spark, sf, "events")
    rows = e.orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id", "event_type", F.row_number().over(W.orderBy(F.desc("ts"), "event_id")).alias("i"))  # of twenty rows
    items = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "event_id", "event_type"))).alias("a"))
    listed = F.transform("a", lambda x: F.struct(x["event_id"].alias("id"), x["event_type"].alias("type")))
    total = e.agg(F.count("*").alias("total"))
    return items.join(F.broadcast(total)).select(F.to_json(F.struct(F.lit(3).alias("page"), F.lit(20).alias("size"), F.col("total"), F.ceil(F.col("total") / 20).alias("pages"), listed.alias("items"))).alias("page"))


def upcoming_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first fifty events that start by the week's end and have not ended, those that touch the week."""
    now, end = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), F.lit("2024-01-21 23:59:59").cast("timestamp_ntz")
    n = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", "ts", F.when(n % 3 > 0, F.timestamp_add("HOUR", (n % 400).cast("int"), F.col("ts"))).alias("end_at"), F.timestamp_add("DAY", (n % 9).cast("int"), F.col("ts")).alias("deadline"))
    first = e.where((F.col("ts") <= end) & ((F.col("end_at") >= now) | (F.col("end_at").isNull() & (F.col("ts") >= now)))).orderBy("ts", "event_id").limit(50)
    return first.where((F.coalesce("end_at", "ts") >= now) | F.col("deadline").between(now, end)).select("event_id", "ts", "end_at")


def personal_range(spark: SparkSession, sf: str) -> DataFrame:
    """Events within a range by their own times or by those that a user's link puts in place, both ends included."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-12 00:00:00"))
    n = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("start_at"), F.timestamp_add("HOUR", (n % 30).cast("int"), F.col("ts")).alias("end_at"))
    links = table(spark, sf, "events").where("event_id % 4 = 0").select("event_id", F.timestamp_add("DAY", (n % 5 - 2).cast("int"), F.col("ts")).alias("own_start"), F.timestamp_add("DAY", (n % 5 - 2).cast("int"), F.col("ts")).alias("own_end"))
    full = e.join(links, "event_id", "left")
    inside = lambda a, b: (F.col(a) <= high) & (F.col(b) >= low)
    return full.where(inside("start_at", "end_at") | F.coalesce(inside("own_start", "own_end"), F.lit(False))).select("event_id", F.coalesce("own_start", "start_at").alias("start_at"))


# Labels whose answers should weigh things and those under pressure; what tells of a role's tag, a rule claimed
# without a source, and risky advice that is not refused.
WEIGHED, PRESSING = ("priority", "tradeoff", "decision", "planning", "risk_assessment"), ("project", "exam", "counseling")
ROLE_TAG = r"(?i)\b(?:Human|User|Assistant)\s*:"
CLAIM_TOPICS = ("과락", "퇴소", "제적", "출결", "수료", "재시험")
CLAIM_FIRM = r"(?:무조건|반드시|바로|즉시)\s*(?:퇴소|제적|탈락|수료\s*불가)"
CLAIM_COUNT = r"[0-9]+\s*(?:번|회|개)\s*(?:이면|부터|이상).*?(?:퇴소|제적|탈락|수료\s*불가)"
RISKY = ("조작", "몰래", "대리출석", "꼼수", "숨기", "답을 알려")
REFUSALS = ("안 됩니다", "도와드릴 수", "권장하지", "위반", "정직", "공식")
#: What the messages of the tables are given, as they hold no such words and have no labels.
EXTRA = (" 우선 1. 확인", " 팀 프로젝트 평가", "", " 준비 - 정리 먼저", " 과락 3번 이상이면 퇴소", " 몰래 조작", " 몰래는 위반", " User : x", " 바로 제적", "")
REASONING, CATEGORIES = ("priority", "knowledge", "tradeoff", "decision", "planning", "risk_assessment"), ("project", "faq", "exam", "life", "counseling")


def rubric_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by five parts: understanding (words of the question and of a model answer, likeness to it), priority,
    context, actions and safety. The question is the message before; the model answer the session's longest."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("asked", F.coalesce(F.lag("text").over(own), F.lit(""))).where("role = 'assistant'")
    c = c.join(table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", F.struct(F.length("text"), "turn")).alias("gold")), "conv_id")
    tokens = lambda x: F.filter(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([A-Za-z0-9가-힣]+)"), F.lit(1)), lambda t: (F.length(t) >= 2) & ~t.isin(*TOKEN_STOPS))
    extra = _pick(EXTRA, F.col("conv_id") + F.col("turn"))
    c = c.withColumn("answer", F.concat(F.coalesce("text", F.lit("")), extra)).withColumn("low", F.lower("answer"))
    c = c.withColumn("a", F.array_distinct(tokens(F.col("answer")))).withColumn("q", F.slice(F.filter(tokens(F.col("asked")), lambda t: ~t.isin(*ASK_STOPS)), 1, 10)).withColumn("g", F.array_distinct(tokens(F.col("gold"))))
    hits = lambda words: sum((F.contains(F.col("low"), F.lit(w)).cast("int") for w in words), F.lit(0))
    of = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("low"), w)))
    shared = F.size(F.array_intersect("a", "g"))
    f1 = F.coalesce(F.try_divide(2.0 * shared, F.size("a") + F.size("g")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(shared, F.size("g")), F.lit(0.0))
    reasoning = _pick(REASONING, F.col("conv_id"))
    category = _pick(CATEGORIES, F.col("conv_id"), 3)
    m = c.select("conv_id", "turn", "answer", f1.alias("f1"), recall.alias("recall"), of("q").alias("q_hits"), of(F.slice("g", 1, 8)).alias("g_hits"), hits(PRIORITY).alias("priority"), hits(DOMAIN).alias("domain"), hits(ACTIONS).alias("actions"), sum((F.contains(F.lower("asked"), F.lit(w)).cast("int") for w in DOMAIN), F.lit(0)).alias("asked_domain"), reasoning.alias("reasoning"), category.alias("category"))
    least = lambda most, value: F.least(F.lit(float(most)), value.cast("double"))
    intent = least(20, 8.0 + least(7, F.col("q_hits") * 2.5) + least(5, F.col("g_hits") * 1.25) + F.when((F.col("f1") >= 0.12) | (F.col("recall") >= 0.2), 2.0).otherwise(0.0))
    raised = least(25, 7.0 + F.col("priority") * 3.0) + F.when(F.col("reasoning").isin(*WEIGHED) & (F.col("priority") >= 2), 4.0).otherwise(0.0)
    judged = least(25, F.when(F.col("category").isin(*PRESSING) & (F.col("priority") == 0), least(8, raised)).otherwise(raised))
    context = 8.0 + least(12, F.col("domain") * 3.0)
    context = least(20, F.when((F.col("asked_domain") > 0) & (F.col("domain") == 0), least(9, context)).otherwise(context))
    listed = F.when(F.col("answer").rlike(r"(?:^|\n|\s)(?:1\.|2\.|3\.|-)"), 3.0).otherwise(0.0)
    action = least(20, 6.0 + F.col("actions") * 2.5 + listed)
    has_any = lambda words: reduce(lambda x, y: x | y, (F.contains("answer", F.lit(w)) for w in words))
    plain = F.regexp_replace("answer", r"^\s+|\s+$", "")
    claim = has_any(CLAIM_TOPICS) & (F.col("answer").rlike(CLAIM_FIRM) | F.col("answer").rlike(CLAIM_COUNT))
    found = [(plain == "", "empty_answer", 5.0), (F.col("answer").rlike(ROLE_TAG), "artifact_tag", 5.0), (F.length(plain) < 20, "too_short", 5.0), (claim, "unsupported_rule_assertion", 5.0), (has_any(RISKY) & ~has_any(REFUSALS), "unsafe_advice", 8.0)]
    issues = all_reasons([(c, name) for c, name, _ in found])
    safety = F.greatest(F.lit(0.0), 15.0 - points([(c, F.lit(cost)) for c, _, cost in found]))
    parts = {"intent": intent, "priority_part": judged, "context": context, "action": action, "safety": safety}
    blank = F.trim("answer") == ""
    return m.select("conv_id", "turn", *(F.round(F.when(blank, 0.0).otherwise(v), 1).alias(k) for k, v in parts.items()), F.array_join(issues, ",").alias("issues"), F.round(F.when(blank, 0.0).otherwise(points([(F.lit(True), v) for v in parts.values()])), 1).alias("score"))


QUERIES = {
    f.__name__: f for f in (run_routes, run_metrics, answer_policies, retrieval_policies, evaluation_risk, filter_dispatch, other_events, few_shot_examples, numbered_pages, upcoming_candidates, personal_range, rubric_parts)
}

_list, _strings, _any = planning._list, planning._strings, planning._any
_at = lambda parts, number, step=1: f"{_list(parts)}[{number} // {step} % {len(parts)} + 1]"
RUNS = f"""r AS (SELECT event_id, ts, {_at(POLICIES, 'event_id')} AS p, {_at(MODES, 'event_id', 7)} AS m, coalesce((props->>'$.k')::INT, 0) % 5 = 0 AS cited, CASE WHEN coalesce((props->>'$.k')::INT, 0) % 3 = 0 THEN trunc(value * 10)::INT END AS tokens FROM events),
    s AS (SELECT *, CASE WHEN p = 'ERROR' OR ends_with(m, '_error') OR starts_with(m, 'ai_server_') THEN 'error' WHEN p = 'DISABLED' THEN 'disabled' WHEN p = 'PERSONAL_CONTEXT_LORA' OR m = 'personal_context_lora' THEN 'personal_db_lora'
        WHEN p = 'LORA_REASONER' OR m = 'lora_reasoner' THEN 'lora' WHEN starts_with(p, 'LLM_INTENT_') OR starts_with(p, 'SERVER_VERIFIED_') THEN CASE WHEN contains(p, 'SCHEDULE_DB') THEN 'llm_intent_db' ELSE 'llm_intent' END
        WHEN starts_with(p, 'SCHEDULE_MEMORY') OR m = 'schedule_memory' OR starts_with(p, 'SCHEDULE_DB') OR m = 'schedule_db_direct' THEN 'db' WHEN p = 'PERSONAL_CONTEXT_LLM' OR m = 'personal_context_llm' THEN 'personal_db_llm'
        WHEN starts_with(p, 'PERSONAL_CONTEXT') THEN 'personal_db' WHEN p = 'RAG_GROUNDED' OR cited THEN 'rag_llm' WHEN p = 'OFFICIAL_NO_CONTEXT' OR m = 'official_no_context' THEN 'rag' WHEN p IN {_strings(FALLBACKS)} THEN 'llm' ELSE 'unknown' END AS stage FROM r),
    u AS (SELECT *, stage IN {_strings(STORED)} AS used_db, stage = 'lora' OR m IN ('lora_reasoner', 'personal_context_lora') OR p IN ('LORA_REASONER', 'PERSONAL_CONTEXT_LORA') AS used_lora, starts_with(p, 'LLM_INTENT_') OR starts_with(p, 'SERVER_VERIFIED_') AS used_intent FROM s),
    v AS (SELECT *, stage IN ('rag', 'rag_llm') OR p = 'RAG_GROUNDED' OR (cited AND NOT used_db) AS used_rag, used_lora OR used_intent OR stage IN ('llm', 'rag_llm', 'personal_db_llm') OR coalesce(tokens, 0) > 0 AS used_llm FROM u),
    w AS (SELECT *, used_llm AND stage NOT IN ('db', 'personal_db') AS converted FROM v)"""
_typed = "CASE " + " ".join(f"WHEN {_any('title', w)} THEN '{n}'" for w, n in planning.TYPES) + " ELSE 'notice' END"
_text = "(lower(title) || ' ' || type)"
_filters = {
    "exam": f"type = 'exam' OR {_any(_text, EXAM_WORDS)}", "subject_exam": f"type = 'exam' AND contains({_text}, '과목평가')", "monthly_exam": f"type = 'exam' AND contains({_text}, '월말평가')",
    "deadline": f"type IN ('deadline', 'assignment') OR {_any(_text, DEADLINE_WORDS)}", "assignment": f"type IN ('deadline', 'assignment') OR {_any(_text, DEADLINE_WORDS)}", "project": f"type = 'project' OR contains({_text}, '프로젝트')",
    "personal": "owner_id IS NOT NULL OR type = 'personal'", "public": "owner_id IS NULL", "holiday": "type = 'holiday'", "notice": "type = 'notice'", "study": "type = 'study'", "online_week": f"{_any(_text, ('온라인위크', '온라인 위크'))}", "important": "important",
}
_tokens = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[A-Za-z0-9가-힣]+'), lambda t: length(t) >= 2 AND t NOT IN {_strings(TOKEN_STOPS)})"
_hits = lambda text, words: f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"
_distinct = questions._first_seen

ORACLES = {
    "run_routes": f"""WITH {RUNS} SELECT event_id, stage, used_db, used_rag, used_llm, used_lora, used_intent, converted, CASE WHEN used_lora THEN 'lora' WHEN stage IN ('db', 'llm_intent_db', 'personal_db') AND NOT used_llm THEN 'server_db_formatter'
        WHEN used_rag AND used_llm THEN 'rag_plus_llm' WHEN used_db AND used_llm THEN 'db_plus_llm' WHEN used_llm THEN 'llm' WHEN used_rag THEN 'rag_no_context' WHEN used_db THEN 'server_db_formatter' ELSE stage END AS generator FROM w""",
    "run_metrics": f"""WITH {RUNS}, d AS (SELECT ts::DATE AS day, * FROM w), t AS (SELECT day, stage, count(*) AS n FROM d GROUP BY ALL), b AS (SELECT day, arg_max(stage, row(n, stage)) AS top_stage FROM t GROUP BY day)
        SELECT day, count(*) AS n, {', '.join(f"round(100 * count(*) FILTER ({c}) / count(*), 1) AS {c}_pct" for c in ('used_db', 'used_rag', 'used_llm', 'used_intent', 'converted'))}, coalesce(round(avg(tokens), 1), 0.0) AS avg_tokens, any_value(top_stage) AS top_stage FROM d JOIN b USING (day) GROUP BY day""",
    "answer_policies": f"""WITH e AS (SELECT event_id, {_at(KINDS, 'event_id')} AS kind, coalesce((props->>'$.k')::INT, 0) % 3 > 0 AS lacking FROM events), p AS (SELECT event_id, CASE WHEN NOT lacking THEN 'RAG_GROUNDED' WHEN kind = 'OFFICIAL' THEN 'OFFICIAL_NO_CONTEXT'
        WHEN kind = 'GENERAL_TECH' THEN 'GENERAL_KNOWLEDGE_FALLBACK' WHEN kind = 'GENERAL_ADVICE' THEN 'GENERAL_ADVICE_FALLBACK' ELSE 'CAUTIOUS_FALLBACK' END AS policy FROM e)
        SELECT event_id, policy, policy <> 'OFFICIAL_NO_CONTEXT' AS use_llm, policy = 'RAG_GROUNDED' AS use_references FROM p""",
    "retrieval_policies": f"""WITH {questions.ASKED}, {questions.DATES}, {questions.PARSED}, n AS (SELECT event_id, CASE p.k WHEN 'SCHEDULE_EXACT_DATE' THEN 'SCHEDULE_METADATA_EXACT' WHEN 'SCHEDULE_MONTH' THEN 'SCHEDULE_METADATA_RANGE' WHEN 'SCHEDULE_RANGE' THEN 'SCHEDULE_METADATA_RANGE' ELSE 'SEMANTIC_RETRIEVAL' END AS name FROM p)
        SELECT event_id, name, name <> 'SEMANTIC_RETRIEVAL' AS use_metadata, name = 'SEMANTIC_RETRIEVAL' AS allow_fallback, name = 'SCHEDULE_METADATA_EXACT' AS exact FROM n""".replace(", n AS (SELECT event_id, CASE p.k", ", names AS (SELECT event_id, CASE p.k").replace("AS exact FROM n", "AS exact FROM names"),
    "evaluation_risk": """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') % 8 AS passed, count(*) FILTER (l_returnflag = 'R') % 6 AS failed FROM lineitem GROUP BY l_suppkey), h AS (SELECT *, greatest(0, 10 - passed - failed) AS l, passed + greatest(0, 10 - passed - failed) / 2 AS half FROM c)
        SELECT l_suppkey, passed, failed, CASE WHEN passed >= 6 THEN 'SAFE' WHEN l <= 0 OR 6 - passed > l THEN 'DANGER' WHEN passed + failed <= 0 THEN 'CAUTION' WHEN 4 - failed <= 0 OR half < 6 THEN 'WARNING' WHEN half = 6 THEN 'CAUTION' WHEN half >= 7 AND 4 - failed >= 2 THEN 'SAFE' ELSE 'CAUTION' END AS level FROM h""",
    "filter_dispatch": f"WITH {planning.PLANNED}, t AS (SELECT *, {_typed} AS type FROM e) " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM t WHERE {c} HAVING count(*) > 0" for n, c in _filters.items()),
    "other_events": f"WITH {planning.PLANNED}, t AS (SELECT event_id, {_typed} AS type, trim({_at(('other', 'exam', 'project', ' exam '), 'event_id', 3)}) AS asked FROM e) SELECT event_id, type FROM t WHERE CASE WHEN asked = 'other' THEN type IN {_strings(OTHER_TYPES)} ELSE type = asked END",
    "few_shot_examples": rf"""WITH x AS (SELECT conv_id * 1000 + turn AS example, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 20),
        d AS (SELECT example, place, {_distinct('w')} AS words FROM x), i AS (SELECT item_id, lower(coalesce(text, '')) AS low, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS own FROM benchmark),
        s AS (SELECT item_id, example, place, 10 * len(list_filter(words[:3], lambda k: contains(low, k))) + len(list_intersect(own, words)) AS score FROM i, d),
        f AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS most FROM s) WHERE score > 0 OR (most <= 0 AND place <= 2))
        SELECT item_id, example, score::INT AS score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) <= 2""",
    "numbered_pages": """WITH p AS (SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40), t AS (SELECT count(*) AS n FROM events)
        SELECT '{"page":3,"size":20,"total":' || any_value(n) || ',"pages":' || ceil(any_value(n) / 20)::BIGINT || ',"items":[' || string_agg('{"id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY ts DESC, event_id) || ']}' AS page FROM p, t""",
    "upcoming_candidates": """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN ts + to_hours(event_id % 400) END AS end_at, ts + to_days((event_id % 9)::INT) AS deadline FROM events),
        f AS (SELECT * FROM e WHERE ts <= TIMESTAMP '2024-01-21 23:59:59' AND (end_at >= TIMESTAMP '2024-01-15 12:00:00' OR (end_at IS NULL AND ts >= TIMESTAMP '2024-01-15 12:00:00')) ORDER BY ts, event_id LIMIT 50)
        SELECT event_id, ts, end_at FROM f WHERE coalesce(end_at, ts) >= TIMESTAMP '2024-01-15 12:00:00' OR deadline BETWEEN TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-21 23:59:59'""",
    "personal_range": """WITH e AS (SELECT event_id, ts AS a, ts + to_hours(event_id % 30) AS z, CASE WHEN event_id % 4 = 0 THEN ts + to_days((event_id % 5 - 2)::INT) END AS o FROM events)
        SELECT event_id, coalesce(o, a) AS start_at FROM e WHERE (a <= TIMESTAMP '2024-01-12' AND z >= TIMESTAMP '2024-01-10') OR (o BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12')""",
    "rubric_parts": rf"""WITH g AS (SELECT conv_id, arg_max(text, row(length(text), turn)) AS gold FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        c AS (SELECT conv_id, turn, role, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS asked, coalesce(text, '') || {_at(EXTRA, '(conv_id + turn)')} AS answer FROM conversations),
        t AS (SELECT *, lower(answer) AS low, list_distinct({_tokens('answer')}) AS a, list_filter({_tokens('asked')}, lambda t: t NOT IN {_strings(ASK_STOPS)})[:10] AS q, {_tokens('gold')} AS g0 FROM c JOIN g USING (conv_id) WHERE role = 'assistant'),
        d AS (SELECT *, {_distinct('g0')} AS g FROM t),
        m AS (SELECT conv_id, turn, answer, coalesce(2.0 * len(list_intersect(a, g)) / nullif(len(a) + len(g), 0), 0) AS f1, coalesce(len(list_intersect(a, g)) / nullif(len(g), 0), 0) AS recall, len(list_filter(q, lambda w: contains(low, w))) AS qh, len(list_filter(g[:8], lambda w: contains(low, w))) AS gh,
            {_hits('low', PRIORITY)} AS ph, {_hits('low', DOMAIN)} AS dh, {_hits('low', ACTIONS)} AS ah, {_hits('lower(asked)', DOMAIN)} AS qd, {_at(REASONING, 'conv_id')} AS reasoning, {_at(CATEGORIES, 'conv_id', 3)} AS category FROM d),
        n AS (SELECT *, least(20.0, 8.0 + least(7.0, qh * 2.5) + least(5.0, gh * 1.25) + CASE WHEN f1 >= 0.12 OR recall >= 0.2 THEN 2.0 ELSE 0 END)::DOUBLE AS i, least(25.0, 7.0 + ph * 3.0) + CASE WHEN reasoning NOT IN ('knowledge') AND ph >= 2 THEN 4.0 ELSE 0 END AS raised,
            least(20.0, CASE WHEN qd > 0 AND dh = 0 THEN least(9.0, 8.0 + least(12.0, dh * 3.0)) ELSE 8.0 + least(12.0, dh * 3.0) END)::DOUBLE AS x, least(20.0, 6.0 + ah * 2.5 + CASE WHEN regexp_matches(answer, '(?:^|\n|\s)(?:1\.|2\.|3\.|-)') THEN 3.0 ELSE 0 END)::DOUBLE AS act,
            list_filter([CASE WHEN regexp_replace(answer, '^\s+|\s+$', '', 'g') = '' THEN 'empty_answer' END, CASE WHEN regexp_matches(answer, '(?i)\b(human|user|assistant)\s*:') THEN 'artifact_tag' END, CASE WHEN length(regexp_replace(answer, '^\s+|\s+$', '', 'g')) < 20 THEN 'too_short' END,
                CASE WHEN regexp_matches(answer, '과락|퇴소|제적|출결|수료|재시험') AND regexp_matches(answer, '(무조건|반드시|바로|즉시)\s*(퇴소|제적|탈락|수료\s*불가)|[0-9]+\s*[번회개]\s*(이면|부터|이상).*?(퇴소|제적|탈락|수료\s*불가)') THEN 'unsupported_rule_assertion' END,
                CASE WHEN regexp_matches(answer, '조작|몰래|대리출석|꼼수|숨기|답을 알려') AND NOT regexp_matches(answer, '안 됩니다|도와드릴 수|권장하지|위반|정직|공식') THEN 'unsafe_advice' END], lambda r: r IS NOT NULL) AS issues FROM m),
        o AS (SELECT *, least(25.0, CASE WHEN category NOT IN ('faq', 'life') AND ph = 0 THEN least(8.0, raised) ELSE raised END)::DOUBLE AS pr, greatest(0.0, 15.0 - 5.0 * len(issues) - CASE WHEN list_contains(issues, 'unsafe_advice') THEN 3.0 ELSE 0 END)::DOUBLE AS safe, trim(answer, ' ') = '' AS blank FROM n)
        SELECT conv_id, turn, {', '.join(f"round(CASE WHEN blank THEN 0.0 ELSE {v} END, 1)::DOUBLE AS {k}" for k, v in (('intent', 'i'), ('priority_part', 'pr'), ('context', 'x'), ('action', 'act'), ('safety', 'safe')))}, array_to_string(issues, ',') AS issues, round(CASE WHEN blank THEN 0.0 ELSE i + pr + x + act + safe END, 1)::DOUBLE AS score FROM o""",
}
