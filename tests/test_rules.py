"""Rules for questions and planned events on cases of their own."""

import datetime as dt
import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import phrases, questions
from quern.queries import planning

TODAY = dt.date(2026, 5, 20)  # a Wednesday


def asked(spark, rows):
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "n int, question string")
    return frame.select("n", phrases.normal(F.col("question")).alias("t"), F.lit(TODAY).alias("today"))


def day(month, number, year=2026):
    return dt.date(year, month, number)


def test_dates_of_questions(spark):
    cases = {
        "오늘 일정 알려줘": (TODAY, TODAY, True), "오늘부터 남은 일정": (TODAY, TODAY + dt.timedelta(365), False), "내일 뭐 있어": (day(5, 21), day(5, 21), True),
        "모레": (day(5, 22), day(5, 22), True), "어제": (day(5, 19), day(5, 19), True), "2025년 12월 3일 시험": (day(12, 3, 2025), day(12, 3, 2025), True),
        "2025-2-30 또는 6월 7일": (day(6, 7), day(6, 7), True), "6월 31일": None, "15일 평가": (day(5, 15), day(5, 15), True), "3일 이내": None, "3일간 2일": (day(5, 2), day(5, 2), True),
        "다음 주 시험": (day(5, 25), day(5, 31), False), "이번주": (day(5, 18), day(5, 24), False), "지난주": (day(5, 11), day(5, 17), False), "저저번달": (day(3, 1), day(3, 31), False),
        "저번달": (day(4, 1), day(4, 30), False), "다음달": (day(6, 1), day(6, 30), False), "이번 월": (day(5, 1), day(5, 31), False), "2월 일정": (day(2, 1), day(2, 28), False), "13월": None, "아무 말": None, None: None,
    }
    got = {r.n: r.d for r in questions.with_dates(asked(spark, list(cases))).select("n", "d").collect()}
    for n, (question, want) in enumerate(cases.items()):
        found = got[n] and tuple(got[n])
        if question == "6월 31일":  # no such day of June: the day of this month stands alone
            assert found == (day(5, 31), day(5, 31), True)
        else:
            assert found == want, question


def test_kinds_of_questions(spark):
    cases = {
        "오늘 일정": ("SCHEDULE_EXACT_DATE", 0), "6월 일정": ("SCHEDULE_MONTH", 0), "이번주 시험": ("SCHEDULE_RANGE", 0), "시험 망했 어떡해": ("GENERAL_CHAT", 0), "가장 가까운 평가": ("SCHEDULE_RANGE", 1), "다가오는 과제": ("SCHEDULE_RANGE", 3),
        "급한 과제": ("SCHEDULE_RANGE", 5), "일정": ("SCHEDULE_RANGE", 0), "공지 보여줘": ("GENERAL_NOTICE", 0), "안녕": ("GENERAL_CHAT", 0), "지금까지 본 시험과 앞으로 볼 시험": ("SCHEDULE_RANGE", 0),
    }
    q = questions.with_dates(asked(spark, list(cases)))
    got = q.select("n", questions.schedule_query(F.col("t"), F.col("today"), F.col("d")).alias("p")).orderBy("n").collect()
    assert [(r.p.query_type, r.p.result_limit) for r in got] == list(cases.values())
    assert (got[-1].p.start_date, got[-1].p.end_date) == (TODAY - dt.timedelta(365), TODAY + dt.timedelta(365))


def test_routes_filters_and_ranks(spark):
    cases = {
        "오늘 날짜 알려줘": ("current_date_rule", "", "", 0), "최근 공지 요약": ("notice_question", "", "", 0), "과락 몇 번이면 퇴소야": ("official_rule_question", "", "", 0), "과락 때문에 불안": ("default", "", "", 0),
        "이번주 큰일 나는 거": ("urgent_recommendation_rule", "", "", 0), "뭐부터 하지": ("recommendation_rule", "", "", 0), "프로젝트 설명해줘": ("project_explanation_question", "", "", 0), "내 성적 평균": ("personal_score_rule", "", "", 0),
        "두번째 시험 일정은": ("complex_schedule_rule", "exam", "", 2), "평가 말고 중요 일정": ("complex_schedule_rule", "important", "exam", 0), "다가오는 시험": ("exam_upcoming_rule", "exam", "", 0), "마감 빼고 공휴일만": ("complex_schedule_rule", "holiday", "deadline,assignment", 0),
    }
    got = asked(spark, list(cases)).select("n", questions.route(F.col("t"), F.lit("GENERAL_CHAT")).alias("r")).orderBy("n").collect()
    assert [(r.r.reason, ",".join(r.r.filters), ",".join(r.r.excludes), r.r["rank"]) for r in got] == list(cases.values())
    assert asked(spark, ["안녕"]).select(questions.route(F.col("t"), F.lit("SCHEDULE_RANGE"))["route"].alias("r")).first().r == "schedule_db"


def test_tokens(spark):
    got = asked(spark, ["이번주 시험 일정 알려줘", "Spring boot 설명해줘요 12월 3회 발표해줘", ""]).select(questions.query_tokens(F.col("t")).alias("w"), questions.notice_tokens(F.col("t")).alias("v")).collect()
    assert [r.w for r in got] == [["시험", "평가", "과목평가", "월말평가", "exam"], ["spring", "boot", "설명", "발표"], []]
    assert [r.v for r in got] == [["시험", "일정"], ["spring", "boot", "설명해줘요", "12월", "3회", "발표해줘"], []]


def test_plans_are_held_to_their_intent(spark):
    rows = [("schedule_query", "DB", [" Schedule ", "score", "schedule"], 0.9), ("schedule_query", "llm", None, 0.9), ("general_chat", "none", [], 0.54), ("nonsense", None, ["rag"], 1.0), ("unknown", "llm", [], 0.9)]
    got = spark.createDataFrame(rows, "i string, r string, s array<string>, c double").select(questions.verified_plan(*map(F.col, "irsc")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [("db", ["schedule"], True, "accepted"), ("db", ["schedule"], True, "route_corrected"), ("clarify", [], False, "low_confidence"), ("clarify", [], False, "clarify_required"), ("clarify", [], False, "low_confidence")]


def test_wrapping_titles_are_those_of_a_plain_loop(spark, sf):
    space = lambda x: re.sub(r"\s+", " ", x or "").strip()
    tight = lambda x: re.sub(r"[\s.()\-_/\]:\[]+", "", space(x)).upper()
    phrase = lambda x: any(w in space(x) for w in planning.WRAPPERS) or re.search(r"트랙\s*시간표", space(x), re.I)
    rows = planning.wrapper_titles(spark, sf).collect()
    for r in rows:
        own, other = tight(r.title), tight(r.source)
        near = other and (own == other or phrase(r.source) and difflib.SequenceMatcher(None, own, other).ratio() >= 0.9)
        assert r.wrapper == bool(not own or phrase(r.title) or r.timetable and near), r
    assert 0 < sum(r.wrapper for r in rows) < len(rows)


@pytest.mark.parametrize(("title", "want"), [("", True), ("12:30~13:30", True), ("7월 3일", True), ("SQL", False), ("js", True), ("설날", False), ("가나", True), ("For All", True), ("house day", True), ("SQL 특강", False)])
def test_meaningless_titles(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(planning.is_meaningless(F.col("t"), (*planning.MEANINGLESS, "ALL"), ("HOUSE",), ("FORALL",)).alias("m")).first().m == want


def test_exams_that_are_not_taken(spark):
    rows = [(1, "과목평가", 1, "exam", 0.9, True), (2, "과목평가1", 1, "exam", 0.9, True), (3, "휴일", 2, "holiday", None, False), (4, "월말평가2", 2, "exam", 0.9, True), (5, "수업", 3, "exam", 0.9, True), (6, "SW 역량테스트", 3, "x", 0.2, False), (7, "SW 역량테스트", 3, "x", None, True)]
    rows += [(10 + d, "평가 과목 7", 4 + d, "exam", 0.5, False) for d in range(5)] + [(20, "공지", 9, "notice", None, False)]
    frame = spark.createDataFrame([(i, t, day(6, d), k, r, p) for i, t, d, k, r, p in rows], "event_id int, title string, day date, event_type string, ratio double, placed boolean")
    got = {r.event_id: r.reason for r in planning.exam_filter(frame).collect()}
    late = "exam_too_many_consecutive_days"
    assert got == {1: "generic_exam_calendar_marker", 2: None, 3: None, 4: "holiday_exam_conflict", 5: "review_required_exam_title", 6: "low_overlap_exam", 7: None, 10: None, 11: None, 12: None, 13: late, 14: late, 20: None}


def test_similar_names_and_compatible_titles_are_those_of_plain_loops(spark, sf):
    from quern.queries import beyond_sql

    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size").collect()
    want = {}
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            if (a.p_brand, a.p_size) == (b.p_brand, b.p_size):
                low, high = sorted((a, b))
                if (ratio := round(difflib.SequenceMatcher(None, low.p_name, high.p_name).ratio(), 6)) >= 0.86:
                    want[low.p_partkey, high.p_partkey] = ratio
    got = {(r.p_partkey, r.other_key): r.ratio for r in beyond_sql.title_similarity(spark, sf).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    key = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t.split("\n")[0]) if unicodedata.category(c)[0] in "LN").upper()
    got = {r.doc_id: r.title_key for r in beyond_sql.compatibility_titles(spark, sf).collect()}
    assert got == {i: None if t is None else key(t) for i, t in texts.items()}


def test_similar_names_of_copies_are_not_expanded_and_lose_no_link(spark, tmp_path):
    """300 parts of six names in two blocks, nulls and an empty name: the classes' rows give back the pairs of plain loops."""
    from quern.queries import beyond_sql

    names = ["small blue ring", "small blue rings", "small blue bring", "blue small ring", "plate", ""]
    rows = [(i, None if i % 97 == 5 else names[i % 6], "a" if i % 2 else "b", 1) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    ratio = {(a, b): round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a in names for b in names}
    want = {(a[0], b[0]): ratio[a[1], b[1]] for a in rows for b in rows if a[0] < b[0] and None not in (a[1], b[1]) and a[2] == b[2] and ratio[a[1], b[1]] >= 0.86}
    found = beyond_sql.title_similarity(spark, str(tmp_path)).collect()
    of = {r.other_key: r.p_partkey for r in found if r.kind == "copy"}
    pairs = {(r.p_partkey, r.other_key): r.ratio for r in found if r.kind == "pair"}
    keys = [r[0] for r in rows if r[1] is not None]
    got = {}
    for a in keys:
        for b in keys:
            x, y = of.get(a, a), of.get(b, b)
            if a < b and (x == y or (x, y) in pairs):
                got[a, b] = 1.0 if x == y else pairs[x, y]
    assert got == want
    assert len(found) < 320 < len(want)


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("오늘 날짜 알려줘", "CURRENT_DATE"), ("무엇 부터 해야 해", "RECOMMENDED_SCHEDULE"), ("추천 일정", "RECOMMENDED_SCHEDULE"), ("추천 영화", "GENERAL"), ("중요 시험", "IMPORTANT_SCHEDULE"), ("중요 인물", "GENERAL"), ("퇴소 위험", "PERSONAL_RISK"),
        ("퇴소 위험 기준", "GENERAL"), ("내 퇴소 위험 기준", "PERSONAL_RISK"), ("성적 알려줘", "PERSONAL_SCORE"), ("성적", "GENERAL"), ("내 성적", "PERSONAL_SCORE"), ("내 점수 통과 기준", "GENERAL"), ("", "GENERAL"),
    ],
)
def test_domain_intents(spark, question, want):
    assert spark.createDataFrame([(question,)], "t string").select(questions.domain_intent(F.col("t")).alias("i")).first().i == want


def test_rubric_safety_of_hand_written_answers(spark, tmp_path):
    """15 less 5 for each of: empty, a role's tag, under 20 characters, a rule claimed; less 8 for risky advice not refused."""
    long = "이것은 스무 글자를 넘는 아주 긴 대답입니다 정말로요"
    # the message's number picks what it is given: numbers 2 and 9 are given nothing
    rows = [(2, 0, "assistant", long), (9, 0, "assistant", "짧다"), (12, 0, "assistant", f"{long} assistant: x"), (19, 0, "assistant", f"{long} 과락이면 반드시 퇴소"), (22, 0, "assistant", f"{long} 몰래"), (29, 0, "assistant", f"{long} 몰래는 위반"), (32, 0, "assistant", f"{long} 과락 3회 이상 제적, 꼼수")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    from quern.queries.policies import rubric_parts

    got = {r.conv_id: (r.safety, r.issues) for r in rubric_parts(spark, str(tmp_path)).collect()}
    assert got == {2: (15.0, ""), 9: (10.0, "too_short"), 12: (10.0, "artifact_tag"), 19: (10.0, "unsupported_rule_assertion"), 22: (7.0, "unsafe_advice"), 29: (15.0, ""), 32: (2.0, "unsupported_rule_assertion,unsafe_advice")}


@pytest.mark.parametrize(("title", "want"), [("ACADEMY", True), ("House-SWAI Day", True), ("all for all", True), ("sw.ai academy", True), ("academy day", False), ("forall x", False)])
def test_scraps_of_a_made_up_institutions_name_mean_nothing(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(planning.is_meaningless(F.col("t")).alias("m")).first().m == want


def test_meaningless_titles_are_those_of_all_rules(spark, sf):
    named = [i for i, t in enumerate(planning.TITLES) if t in ("HouseSWAI Academy", "for all")]
    found = {r.title for r in planning.meaningless_titles(spark, sf).where("meaningless").join(planning.planned(spark, sf), "event_id").select("title").distinct().collect()}
    assert len(named) == 2 and found >= {planning.TITLES[i] for i in named}


def test_an_institutions_name_is_no_notice_title(spark, sf):
    from quern.queries import notices

    found = notices.notices(spark, sf, notices.NOTICE_TITLES).select("event_id", F.col("title").alias("own")).where("own = 'ACADEMY'").join(notices.notice_titles(spark, sf), "event_id")
    assert found.count() > 0 and found.where("title LIKE '보드 %' OR title LIKE '둘째 %' OR title LIKE '제목 %'").count() == found.where("event_id % 8 IN (2, 4, 5)").count() > 0


def test_the_institutions_own_notices_are_seen_in_the_calendar(spark, sf):
    from quern.queries import notices

    own = notices.calendar_visible(spark, sf).where("floor(event_id / 5) % 6 = 1 AND event_id % 5 IN (0, 3) AND floor(event_id / 3) % 5 IN (1, 2) AND floor(event_id / 2) % 3 <> 1 AND event_id % 9 <> 0")
    assert {r.step for r in own.select("step").distinct().collect()} == {"notice source"}


def test_suspicious_events_have_scraps_of_names_in_code_and_sql(spark, sf):
    import duckdb

    from quern.queries import notices

    e = planning.planned(spark, sf).where("title IN ('HouseSWAI Academy', 'for all')").select("event_id")
    found = notices.suspicious_events(spark, sf).join(e, "event_id")
    assert found.count() == e.count() and found.where("NOT contains(reasons, 'meaningless_title')").isEmpty()
    ids = {r.event_id for r in e.collect()}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    told = {r[0] for r in duckdb.sql(notices.ORACLES["suspicious_events"]).fetchall() if "meaningless_title" in r[1]}
    assert ids and ids <= told


def test_questions_of_copied_events_are_routed_once(spark, sf, tmp_path):
    from quern.queries import questions as queries

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.union(events.withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType))).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.route_decision(spark, str(tmp_path))
    assert got.count() == 2 * events.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and plan.index("parsed_schedule_rule") < plan.index("Aggregate [")  # rules stand above the distinct questions
