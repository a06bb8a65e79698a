"""Questions: their dates, kinds, routes, filters, ranks, tokens and verified plans.

The test tables hold no questions of the surveyed language, so each event asks one: phrases picked by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import phrases, questions
from quern.functions.rules import first_rule
from quern.operators.partitions import once_each
from quern.sources.tables import table

#: Parts of a question: when, who, what, and what is asked, with spaces and case to be normalised.
WHEN = ("", "오늘", "내일", "모레까지", "어제", "오늘 이후", "다음 주", "이번주", "지난주", "저저번달", "저번달", "다음달", "이번 달", "7월", "13월", "2월 30일", "3월 5일", "2026년 4월 9일", "2026-02-31", "2025.12.1", "15일", "3일 이내", "31일", "가까운", "앞으로", "지금까지 있었던 것과 앞으로 남은")
WHO = ("", "내", "나는", "현재", "개인", "공용  일정 말고", "Track")
WHAT = ("일정", "시험", "과목평가", "월말평가 일정", "마감만", "프로젝트 설명", "프로젝트만", "공휴일", "공휴일 빼고", "과제 제외하고", "공지", "위험도", "과락 몇 번", "수료 기준 점수", "약한 과목 성적", "퇴소 위험과 성적", "성적 평균", "뭐부터 준비", "두 번째 중요 일정", "제일 가까운 평가", "평가 말고 셋째 일정", "불안한 마음", "망했 시험", "SPRING  boot", "최근 중요 일정")
ASK = ("", "알려줘", "보여줘요", "언제야?", "요약해줘", "뭐야", "어떻게 해", "추천 해줘", "이번주 큰일", "있어", "설명", "확인해줘")


def _sizes() -> list[tuple[tuple[str, ...], int]]:
    """Each list of parts and how many event numbers share one of them before the next."""
    return [(WHEN, 1), (WHO, 3), (WHAT, 7), (ASK, 11)]


def asked(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda parts, step: F.element_at(F.array(*map(F.lit, parts)), (F.floor(F.col("event_id") / step) % len(parts) + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("today"), "event_type", "value", F.concat_ws("  ", *(pick(*p) for p in _sizes())).alias("question"))
    return e.withColumn("t", phrases.normal(F.col("question")))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The same questions in SQL, as q(event_id, today, event_type, value, t).
ASKED = "q AS (SELECT event_id, ts::DATE AS today, event_type, value, trim(regexp_replace(lower(concat_ws('  ', " + ", ".join(f"{_list(p)}[(event_id // {n}) % {len(p)} + 1]" for p, n in _sizes()) + r")), '\s+', ' ', 'g')) AS t FROM events)"


def question_dates(spark: SparkSession, sf: str) -> DataFrame:
    found = once_each(asked(spark, sf).select("event_id", "t", "today"), questions.with_dates, "t", "today").select("event_id", F.inline(F.array("d")))
    return found.where("start_date IS NOT NULL")


def _parsed(own: DataFrame) -> DataFrame:
    return questions.with_dates(own).withColumn("p", questions.schedule_query(F.col("t"), F.col("today"), F.col("d")))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """What is asked, read once for all who ask the same on the same day."""
    return once_each(asked(spark, sf).select("event_id", "t", "today"), _parsed, "t", "today")


def query_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("event_id", "p.*")


def filter_extraction(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return asked(spark, sf).select("event_id", F.array_join(questions.include_filters(t), ",").alias("include"), F.array_join(questions.exclude_filters(t), ",").alias("exclude"))


def ordinal_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The event of the asked rank among the day's events of its type by value; none where nothing is asked."""
    from pyspark.sql import Window as W

    q = asked(spark, sf).withColumn("rank", questions.rank(F.col("t")))
    e = q.withColumn("place", F.row_number().over(W.partitionBy("today", "event_type").orderBy(F.desc_nulls_last("value"), "event_id")))
    picked = e.where("place <= 3").select("today", "event_type", F.col("place").alias("rank"), F.col("event_id").alias("picked_id"))
    return q.where("rank > 0").join(picked, ["today", "event_type", "rank"], "left").select("event_id", "rank", "picked_id")


def domain_intents(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("event_id", questions.domain_intent(F.col("t")).alias("intent"))


def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Where a question goes: its rules run once for all who ask the same on the same day."""
    routed = lambda own: _parsed(own).withColumn("r", questions.route(F.col("t"), F.col("p.query_type"))).select("t", "today", "r")
    r = once_each(asked(spark, sf).select("event_id", "t", "today"), routed, "t", "today")
    return r.select("event_id", "r.reason", "r.route", "r.personal", F.array_join("r.filters", ",").alias("filters"), F.array_join("r.excludes", ",").alias("excludes"), "r.rank")


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("event_id", F.array_join(questions.query_tokens(F.col("t")), "|").alias("tokens"))


def notice_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("event_id", F.array_join(questions.notice_tokens(F.col("t")), "|").alias("tokens"))


def match_count_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's place by how many of a query's words its name and type hold, then by size and name."""
    from quern.operators.ranking import spread_rank

    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    words = F.split(F.lit("green steel promo blue small"), " ")
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_name", F.size(F.filter(words, lambda w: text.contains(w))).alias("matches"))
    return p.where("matches > 0").select("p_partkey", "matches", F.struct(-F.col("matches"), "p_size", "p_name", "p_partkey").alias("key")).orderBy("key").limit(50).select("p_partkey", "matches")


def intent_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed plans made of event numbers, verified."""
    names = F.array(*(F.lit(i[0]) for i in phrases.INTENTS), F.lit("other"))
    ways = F.array(*map(F.lit, (*phrases.PLAN_ROUTES, "DB", "elsewhere", "")))
    sources = F.array(*map(F.lit, ("schedule", " Risk ", "score", "rag", "notice", "memory", "calendar")))
    n = F.col("event_id")
    at = lambda a, size, step: F.element_at(a, (F.floor(n / step) % size + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", at(names, len(phrases.INTENTS) + 1, 1).alias("intent"), at(ways, 9, 11).alias("proposed"), F.slice(sources, (n % 5 + 1).cast("int"), (n % 4).cast("int")).alias("named"), (F.pmod(n, F.lit(21)) / 20).alias("confidence"))
    p = e.withColumn("p", questions.verified_plan(F.col("intent"), F.col("proposed"), F.col("named"), F.col("confidence")))
    return p.select("event_id", "intent", "p.route", F.array_join("p.sources", ",").alias("sources"), "p.allowed", "p.reason")


QUERIES = {f.__name__: f for f in (question_dates, query_parse, filter_extraction, ordinal_extraction, domain_intents, route_decision, query_tokens, notice_tokens, match_count_order, intent_plan)}


def _filters(table_of, condition) -> str:
    return "array_to_string(list_filter(list_concat(" + ", ".join(f"CASE WHEN {condition(words).sql('t')} THEN {_list(names)} ELSE [] END" for words, names in table_of) + "), lambda x: x IS NOT NULL), ',')"


INCLUDE = _filters(phrases.INCLUDE, lambda w: phrases.says(*w))
EXCLUDE = _filters(phrases.EXCLUDE, phrases.excluded)
RANK = "CASE " + " ".join(f"WHEN {phrases.tight_says(*w).sql('t')} THEN {n}" for n, w in phrases.RANKS) + " ELSE 0 END"

#: Date ranges in SQL. Its patterns have no look-around: what must not stand there is taken out or matched beside.
DATES = r"""n AS (SELECT *, replace(t, ' ', '') AS c, regexp_replace(t, '[0-9]{1,2}\s*일\s*(이내|동안|간)', '', 'g') AS b, year(today)::VARCHAR AS y FROM q),
    f AS (SELECT *, try_cast(regexp_extract(t, '([0-9]{4})\s*(?:년|[-./])\s*([0-9]{1,2})\s*(?:월|[-./])\s*([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(t, '([0-9]{4})\s*(?:년|[-./])\s*([0-9]{1,2})\s*(?:월|[-./])\s*([0-9]{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(t, '([0-9]{4})\s*(?:년|[-./])\s*([0-9]{1,2})\s*(?:월|[-./])\s*([0-9]{1,2})', 3), 2, '0') AS DATE) AS d1,
        try_cast(y || '-' || lpad(regexp_extract(t, '([0-9]{1,2})\s*월\s*([0-9]{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(t, '([0-9]{1,2})\s*월\s*([0-9]{1,2})', 2), 2, '0') AS DATE) AS d2,
        try_cast(y || '-' || lpad(month(today)::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(b, '(?:^|[^0-9])([0-9]{1,2})\s*일', 1), 2, '0') AS DATE) AS d3,
        try_cast(y || '-' || lpad(regexp_extract(t, '(?:^|[^0-9])([0-9]{1,2})\s*월\s*(?:[^0-9 ]|$)', 1), 2, '0') || '-01' AS DATE) AS d4 FROM n),
    s AS (SELECT *, CASE WHEN regexp_matches(c, '오늘부터|오늘이후') THEN {'a': today, 'z': (today + INTERVAL 365 DAY)::DATE, 'e': false} WHEN contains(c, '오늘') THEN {'a': today, 'z': today, 'e': true}
        WHEN contains(c, '내일') THEN {'a': today + 1, 'z': today + 1, 'e': true} WHEN contains(c, '모레') THEN {'a': today + 2, 'z': today + 2, 'e': true} WHEN contains(c, '어제') THEN {'a': today - 1, 'z': today - 1, 'e': true}
        WHEN d1 IS NOT NULL THEN {'a': d1, 'z': d1, 'e': true} WHEN d2 IS NOT NULL THEN {'a': d2, 'z': d2, 'e': true} WHEN d3 IS NOT NULL THEN {'a': d3, 'z': d3, 'e': true}
        WHEN contains(c, '다음주') THEN {'a': date_trunc('week', today + 7)::DATE, 'z': date_trunc('week', today + 7)::DATE + 6, 'e': false}
        WHEN contains(c, '이번주') THEN {'a': date_trunc('week', today)::DATE, 'z': date_trunc('week', today)::DATE + 6, 'e': false}
        WHEN regexp_matches(c, '저번주|지난주') THEN {'a': date_trunc('week', today - 7)::DATE, 'z': date_trunc('week', today - 7)::DATE + 6, 'e': false}
        WHEN contains(c, '저저번달') THEN {'a': (date_trunc('month', today) - INTERVAL 2 MONTH)::DATE, 'z': (date_trunc('month', today) - INTERVAL 1 MONTH)::DATE - 1, 'e': false}
        WHEN regexp_matches(c, '저번달|지난달') THEN {'a': (date_trunc('month', today) - INTERVAL 1 MONTH)::DATE, 'z': date_trunc('month', today)::DATE - 1, 'e': false}
        WHEN contains(c, '다음달') THEN {'a': (date_trunc('month', today) + INTERVAL 1 MONTH)::DATE, 'z': (date_trunc('month', today) + INTERVAL 2 MONTH)::DATE - 1, 'e': false}
        WHEN regexp_matches(c, '이번달|이번월') THEN {'a': date_trunc('month', today)::DATE, 'z': last_day(today), 'e': false}
        WHEN d4 IS NOT NULL THEN {'a': d4, 'z': last_day(d4), 'e': false} END AS d FROM f)"""
_at = lambda c: c.sql("t")
_q = questions
PARSED = f"""p AS (SELECT *, CASE
        WHEN {_at(_q.SCHEDULE & _q.ADVICE & ~_q.ASKS)} AND d.a IS NULL THEN {{'k': 'GENERAL_CHAT', 'a': NULL::DATE, 'z': NULL::DATE, 'e': false, 'n': 0}}
        WHEN {_at(_q.SCHEDULE & _q.TIMELINE)} THEN {{'k': 'SCHEDULE_RANGE', 'a': today - 365, 'z': today + 365, 'e': false, 'n': 0}}
        WHEN {_at(_q.SCHEDULE)} AND d.e THEN {{'k': 'SCHEDULE_EXACT_DATE', 'a': d.a, 'z': d.z, 'e': true, 'n': 0}}
        WHEN {_at(_q.SCHEDULE)} AND date_trunc('month', d.a) = date_trunc('month', d.z) AND day(d.a) = 1 AND {_at(~_q.WEEKS)} THEN {{'k': 'SCHEDULE_MONTH', 'a': d.a, 'z': d.z, 'e': false, 'n': 0}}
        WHEN {_at(_q.SCHEDULE)} AND d.a IS NOT NULL THEN {{'k': 'SCHEDULE_RANGE', 'a': d.a, 'z': d.z, 'e': false, 'n': 0}}
        WHEN {_at(_q.SCHEDULE & _q.UPCOMING)} THEN {{'k': 'SCHEDULE_RANGE', 'a': today, 'z': today + 365, 'e': false, 'n': CASE WHEN regexp_matches(t, '가장|제일|다음으로') THEN 1 ELSE 3 END}}
        WHEN {_at(_q.SCHEDULE & _q.IMPORTANT)} THEN {{'k': 'SCHEDULE_RANGE', 'a': today, 'z': today + 30, 'e': false, 'n': CASE WHEN regexp_matches(t, '다음으로|제일') THEN 1 ELSE 5 END}}
        WHEN {_at(_q.SCHEDULE)} THEN {{'k': 'SCHEDULE_RANGE', 'a': today, 'z': today + 30, 'e': false, 'n': 0}}
        WHEN {_at(_q.NOTICE)} THEN {{'k': 'GENERAL_NOTICE', 'a': d.a, 'z': d.z, 'e': coalesce(d.e, false), 'n': 0}}
        ELSE {{'k': 'GENERAL_CHAT', 'a': NULL::DATE, 'z': NULL::DATE, 'e': false, 'n': 0}} END AS p FROM s)"""
_reason = "CASE " + " ".join(f"WHEN {_at(c)} THEN '{reason}'" for reason, _, _, c in phrases.ROUTES) + " WHEN p.k <> 'GENERAL_CHAT' THEN 'parsed_schedule_rule' ELSE 'default' END"
_way = "CASE reason " + " ".join(f"WHEN '{reason}' THEN '{way}'" for reason, way, _, _ in phrases.ROUTES) + " WHEN 'parsed_schedule_rule' THEN 'schedule_db' ELSE 'llm' END"
_strip = "CASE " + " ".join(f"WHEN ends_with(x, '{w}') AND length(x) > {len(w) + 1} THEN x[:length(x) - {len(w)}]" for w in phrases.SUFFIXES) + " ELSE x END AS x"


def _first_seen(items: str) -> str:
    """Distinct items of a list in order of arrival."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


ORACLES = {
    "domain_intents": "WITH " + ASKED + r""", f AS (SELECT event_id, replace(t, ' ', '') AS k, regexp_matches(t, '기준|조건|규정|몇 ?점 이상') AS official, regexp_matches(t, '내 |내가|나는|나의|현재|지금|입력한|받은') AS own, t FROM q)
        SELECT event_id, CASE WHEN regexp_matches(k, '(오늘|현재)날짜|오늘며칠|오늘이(몇일|무슨날)') THEN 'CURRENT_DATE'
            WHEN regexp_matches(k, '(뭐|무엇)부터|(뭘|무엇을|뭐)준비') OR (regexp_matches(t, '추천|우선할|먼저') AND regexp_matches(t, '일정|스케줄|준비|공부|해야|할 ?일')) THEN 'RECOMMENDED_SCHEDULE'
            WHEN regexp_matches(t, '중요|급한|긴급|우선순위') AND regexp_matches(t, '일정|스케줄|할 ?일|마감|시험|평가') THEN 'IMPORTANT_SCHEDULE'
            WHEN regexp_matches(t, '위험도|위험 단계|(현재|내|수료) 상태|수료 가능|퇴소 위험|한 ?번 더 과락|과락 여유') AND (own OR NOT official) THEN 'PERSONAL_RISK'
            WHEN regexp_matches(t, '성적|점수|몇 ?점|평균|(합격|불합격|과락) 횟수|몇 ?번 과락|과락 몇 ?번') AND NOT official AND (own OR regexp_matches(t, '알려|보여|확인|어때|얼마')) THEN 'PERSONAL_SCORE' ELSE 'GENERAL' END AS intent FROM f""",
    "question_dates": f"WITH {ASKED}, {DATES} SELECT event_id, d.a AS start_date, d.z AS end_date, d.e AS exact FROM s WHERE d IS NOT NULL",
    "query_parse": f"WITH {ASKED}, {DATES}, {PARSED} SELECT event_id, p.k AS query_type, p.a AS start_date, p.z AS end_date, p.e AS exact, p.n::INT AS result_limit FROM p",
    "filter_extraction": f"WITH {ASKED} SELECT event_id, {INCLUDE} AS include, {EXCLUDE} AS exclude FROM q",
    "ordinal_extraction": f"""WITH {ASKED}, r AS (SELECT *, {RANK} AS rank, row_number() OVER (PARTITION BY today, event_type ORDER BY value DESC NULLS LAST, event_id) AS place FROM q)
        SELECT r.event_id, r.rank, p.event_id AS picked_id FROM r LEFT JOIN r p ON p.today = r.today AND p.event_type = r.event_type AND p.place = r.rank WHERE r.rank > 0""",
    "route_decision": f"""WITH {ASKED}, {DATES}, {PARSED}, r AS (SELECT *, {_reason} AS reason FROM p)
        SELECT event_id, reason, {_way} AS route, reason IN ({', '.join(f"'{r}'" for r, _, own, _ in phrases.ROUTES if own)}) AS personal,
            CASE WHEN reason IN ('exam_timeline_rule', 'exam_upcoming_rule') THEN 'exam' WHEN reason = 'complex_schedule_rule' THEN {INCLUDE} ELSE '' END AS filters,
            CASE WHEN reason IN ('exam_timeline_rule', 'exam_upcoming_rule', 'complex_schedule_rule') THEN {EXCLUDE} ELSE '' END AS excludes,
            CASE WHEN reason IN ('exam_upcoming_rule', 'complex_schedule_rule') THEN {RANK} ELSE 0 END AS rank FROM r""",
    "query_tokens": rf"""WITH {ASKED}, w AS (SELECT event_id, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(phrases.QUERY_STOPS)}, x)) AS w FROM q),
        u AS (SELECT event_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), b1 AS (SELECT event_id, i, {_strip} FROM u), b2 AS (SELECT event_id, i, {_strip} FROM b1), b AS (SELECT event_id, i, {_strip} FROM b2),
        k AS (SELECT event_id, i, CASE x {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in phrases.SYNONYMS.items())} ELSE [x] END AS xs FROM b
            WHERE length(x) >= 2 AND NOT list_contains({_list(phrases.QUERY_STOPS)}, x) AND NOT regexp_full_match(x, '[0-9]+(?:년|월|일|회|차)?')),
        e AS (SELECT event_id, i, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM k), o AS (SELECT event_id, x, min(i * 100 + j) AS o FROM e GROUP BY event_id, x),
        g AS (SELECT event_id, string_agg(x, '|' ORDER BY o) AS tokens FROM o GROUP BY event_id)
        SELECT event_id, coalesce(tokens, '') AS tokens FROM q LEFT JOIN g USING (event_id)""",
    "notice_tokens": rf"""WITH {ASKED}, w AS (SELECT event_id, list_filter(regexp_split_to_array(translate(t, '?.', '  '), '\s+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(phrases.NOTICE_STOPS)}, x)) AS w FROM q)
        SELECT event_id, array_to_string({_first_seen('w')}, '|') AS tokens FROM w""",
    "match_count_order": """WITH m AS (SELECT p_partkey, p_size, p_name, len(list_filter(['green', 'steel', 'promo', 'blue', 'small'], lambda w: contains(lower(p_name || ' ' || p_type), w))) AS matches FROM part)
        SELECT p_partkey, matches::INT AS matches FROM m WHERE matches > 0 ORDER BY matches DESC, p_size, p_name, p_partkey LIMIT 50""",
    "intent_plan": f"""WITH i(intent, home, own, ok, ways) AS (VALUES {', '.join(f"('{n}', '{d}', {_list(s)}::VARCHAR[], {_list(a)}::VARCHAR[], {_list(w)})" for n, d, s, a, w in phrases.INTENTS)}),
        e AS (SELECT event_id, {_list([x[0] for x in phrases.INTENTS] + ['other'])}[event_id % {len(phrases.INTENTS) + 1} + 1] AS intent, lower({_list((*phrases.PLAN_ROUTES, 'DB', 'elsewhere', ''))}[event_id // 11 % 9 + 1]) AS proposed,
            ['schedule', ' Risk ', 'score', 'rag', 'notice', 'memory', 'calendar'][event_id % 5 + 1:event_id % 5 + event_id % 4] AS named, (event_id % 21) / 20 AS confidence FROM events),
        j AS (SELECT e.*, coalesce(home, 'clarify') AS home, coalesce(own, []) AS own, coalesce(ok, []) AS ok, coalesce(ways, ['clarify']) AS ways FROM e LEFT JOIN i USING (intent)),
        a AS (SELECT *, CASE WHEN proposed IN ({', '.join(f"'{w}'" for w in phrases.PLAN_ROUTES if w != 'none')}) THEN proposed ELSE home END AS asked, list_filter(list_transform(named, lambda s: lower(trim(s))), lambda s: list_contains(ok, s)) AS fit FROM j),
        w AS (SELECT *, list_contains(ways, asked) AS fits, CASE WHEN list_contains(ways, asked) THEN asked ELSE home END AS way, confidence >= 0.55 AND intent <> 'unknown' AS sure, CASE WHEN len(fit) > 0 THEN {_first_seen('fit')} ELSE own END AS held FROM a)
        SELECT event_id, intent, CASE WHEN sure OR way = 'clarify' THEN way ELSE 'clarify' END AS route, CASE WHEN sure OR way = 'clarify' THEN array_to_string(held, ',') ELSE '' END AS sources, sure AND way <> 'clarify' AS allowed,
            CASE WHEN way = 'clarify' THEN 'clarify_required' WHEN NOT sure THEN 'low_confidence' WHEN NOT fits THEN 'route_corrected' ELSE 'accepted' END AS reason FROM w""",
}
