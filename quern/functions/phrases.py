"""What a question says: tests for words, combined to conditions, and the fixed word tables of the rules.

A condition is built once and gives a column, or DuckDB SQL for the same test. Words are looked for in the
normal text (lower case, single spaces) or in it without spaces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    """``kind`` is words, tight (words without spaces), all, any or none; ``parts`` are words or conditions."""

    kind: str
    parts: tuple

    def __and__(self, other: Condition) -> Condition:
        return Condition("all", (self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("any", (self, other))

    def __invert__(self) -> Condition:
        return Condition("none", (self,))

    def column(self, text: Column) -> Column:
        if self.kind in ("words", "tight"):
            return (text if self.kind == "words" else tight(text)).rlike("|".join(self.parts))
        own = [p.column(text) for p in self.parts]
        if self.kind == "none":
            return ~own[0]
        return own[0] & own[1] if self.kind == "all" else own[0] | own[1]

    def sql(self, text: str) -> str:
        if self.kind in ("words", "tight"):
            return f"regexp_matches({text if self.kind == 'words' else f"replace({text}, ' ', '')"}, '{'|'.join(self.parts)}')"
        own = [p.sql(text) for p in self.parts]
        return f"NOT ({own[0]})" if self.kind == "none" else f"({own[0]} {'AND' if self.kind == 'all' else 'OR'} {own[1]})"


def says(*words: str) -> Condition:
    return Condition("words", words)


def tight_says(*words: str) -> Condition:
    return Condition("tight", words)


def normal(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " "))


def tight(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def excluded(targets: Sequence[str]) -> Condition:
    """A target right before one of the words that exclude it."""
    return tight_says(*(t + w for t in targets for w in EXCLUDING))


# The words of the surveyed rules.
TODAY = ("오늘날짜", "현재날짜", "오늘며칠", "오늘이몇일", "오늘이무슨날")
NOTICES = ("공지", "공지사항", "안내", "알림")
NOTICE_ASKS = ("요약", "정리", "알려", "보여", "확인", "중요", "최근")
RULE_SUBJECTS = ("과락", "불합격", "퇴소", "중도퇴소", "수료", "재시험", "출결", "지각", "결석", "조퇴", "공가", "사유결석")
RULE_MARKERS = ("기준", "조건", "규정", "몇 번", "몇번", "얼마나", "몇 점", "몇점", "점수", "횟수", "통과", "합격", "불합격", "처리", "불이익")
RULE_TIGHT = ("몇번이면", "몇번부터", "얼마나", "과락몇번", "퇴소기준", "수료기준", "통과기준")
FAILING, DROPPING = ("과락", "불합격"), ("퇴소", "중도퇴소", "수료")
ADVICE = ("어떡하지", "어떻게 하지", "어떻게 해", "회복", "공부", "복구", "준비", "멘탈", "힘들", "불안", "망했", "망함", "우울")
URGENT = ("숨막히", "큰일", "위험한", "위험하다", "위험한거", "위험한것", "망하는", "망할", "당장준비", "제일위험", "위험도")
URGENT_TIMES, URGENT_SELF = ("이번주", "곧", "다가오는", "당장", "제일"), ("나", "내")
DIRECT = ("뭐부터", "무엇부터", "미준비", "뭐준비", "먼저뭐", "신경써야", "신경써야할", "빡센거", "조심해야")
RECOMMEND, RECOMMENDED = ("추천", "먼저", "준비", "신경", "빡센", "조심"), ("일정", "스케줄", "할 일", "해야", "평가", "마감")
PROJECTS = ("프로젝트", "관통pjt", "관통프로젝트", "최종관통")
EXPLAIN = ("설명", "뭐야", "무엇", "어떻게", "방법", "가이드", "주의사항", "준비", "진행", "평가방식", "제출방법", "내용", "정리", "알려줘", "알려", "대해")
DATE_ONLY = ("일정", "언제", "날짜", "몇일", "가까운")
WEAK, WEAK_OF = ("과락가능성", "약한과목", "낮은과목"), ("과목", "성적", "점수", "평가")
SELF = ("내 ", "내가", "나 ", "나는", "나의", "난", "현재", "지금")
RISKS = ("위험", "위험해", "괜찮", "수료 가능", "수료 상태", "퇴소", "과락 여유", "과락 상태", "내 상태")
RISKS_TIGHT, RISK_OF = ("과락상태", "퇴소언제", "수료가능"), ("성적", "점수", "과락", "평가", "수료")
BARE_RISK, BARE_OF = ("위험도평가", "위험도", "수료가능"), ("이번달", "현재", "지금", "성적", "평가")
OFFICIAL = ("기준", "조건", "규정", "통과 기준", "수료 기준")
SCORES = ("성적", "점수", "평균", "합격 횟수", "불합격 횟수", "과락 횟수", "몇 번 과락", "몇번 과락", "과락 몇 번", "과락 몇번")
SCORES_TIGHT = ("과락몇번", "몇번과락", "몇번했")
IMPORTANT_ASKS = ("최근중요일정", "중요일정보여", "중요일정확인")
EXAMS = ("시험", "평가", "과목평가", "월말평가")
PAST, FUTURE = ("지금까지", "있었던", "지난", "이전", "과거"), ("앞으로", "남은", "예정", "이후")
SCHEDULES = ("일정", "스케줄", "언제", "날짜")
EXAM_SOON = ("가까운", "다가오는", "곧", "있음", "있냐", "있어")
PLANNED = ("일정", "스케줄", "평가", "시험", "마감", "제출", "중요", "프로젝트", "공휴일")
PLANNED_KINDS = ("중요", "우선순위", "공용", "공식", "개인", "내 일정")
ONLY = ("평가만", "시험만", "마감만", "제출만", "프로젝트만", "프로젝트일정만", "공휴일만")
EXCLUDING = ("말고", "빼고", "제외", "제외하고")
SCHEDULE_WORDS = ("일정", "스케줄", "할 일", "할일", "언제", "마감", "제출", "평가", "시험", "월말평가", "과목평가", "프로젝트", "과제")
UPCOMING = ("가까운", "다가오는", "예정된", "예정인", "앞으로", "곧", "다음으로")
IMPORTANT = ("중요", "급한", "긴급", "우선순위", "조심")
OVERRIDES = ("망했", "망친", "망한", "회복", "불안", "힘들", "멘탈", "포기", "지쳤", "떨어졌", "못봤")
SCHEDULE_ASKS = ("일정", "스케줄", "언제", "날짜", "몇일", "몇 시", "가까운", "다가오는", "예정")
#: For each kind of filter, what asks for it and what it adds.
INCLUDE = (
    (("마감만", "제출만", "마감 알려", "마감 일정", "마감 중"), ("deadline", "assignment")),
    (("평가만", "시험만", "평가 일정", "시험 날짜", "시험 일정", "평가 알려", "시험 알려"), ("exam",)),
    (("프로젝트만", "프로젝트 일정", "프로젝트 일정만", "프로젝트 알려"), ("project",)),
    (("공휴일만", "휴일만"), ("holiday",)),
    (("중요", "우선순위"), ("important",)),
    (("개인", "내 일정"), ("personal",)),
    (("공용", "공식"), ("public",)),
)
EXCLUDE = (
    (("평가", "시험"), ("exam",)),
    (("마감", "제출", "과제"), ("deadline", "assignment")),
    (("프로젝트",), ("project",)),
    (("공휴일", "휴일"), ("holiday",)),
    (("개인", "개인일정", "내일정"), ("personal",)),
)
RANKS = ((2, ("두번째", "두번째로", "2번째", "둘째")), (3, ("세번째", "세번째로", "3번째", "셋째")), (1, ("첫번째", "첫번째로", "1번째", "제일")))
QUERY_STOPS = (
    "일정", "스케줄", "알려줘", "알려", "개인", "내", "오늘", "내일", "어제", "이번", "이번주", "이번달", "이번월", "다음", "다음주", "다음달", "저번", "저번주",
    "저번달", "지난", "지난주", "지난달", "저저번달", "가까운", "다가오는", "예정된", "예정인", "앞으로", "곧", "다음으로", "가장", "제일", "뭐", "뭐야", "뭐니",
    "뭐있어", "뭐있니", "있는지", "있어", "있니", "있나요", "있을까", "확인", "확인해줘", "찾아줘", "보여줘", "보여", "조회", "조회해줘", "요약", "요약해줘",
    "정리", "정리해줘", "말해줘", "설명해줘", "알고싶어", "궁금해",
)
SUFFIXES = ("해줘", "해", "줘", "요")
SYNONYMS = {
    "시험": ("시험", "평가", "과목평가", "월말평가", "exam"),
    "평가": ("평가", "과목평가", "월말평가", "시험", "exam"),
    "과목평가": ("과목평가", "평가", "시험", "exam"),
    "월말평가": ("월말평가", "평가", "시험", "exam"),
}
NOTICE_STOPS = ("이번주", "이번", "오늘", "내일", "공지", "공지사항", "요약", "정리", "알려줘", "보여줘", "확인", "최근", "중요", "뭐야", "무엇")

#: The ordered rules of a verified route: reason, route, whether it needs the asker's own data, condition.
_RULED = says(*RULE_MARKERS)
_DROPPED = says(*FAILING) & says(*DROPPING)
_EXAM = says(*EXAMS)
_OWN = says(*SELF, "입력한", "받은")
_ANY_EXCLUDED = tight_says(*(t + w for targets, _ in EXCLUDE for t in targets for w in EXCLUDING))
ROUTES = (
    ("current_date_rule", "current_date", False, tight_says(*TODAY)),
    ("notice_question", "rag", False, says(*NOTICES) & says(*NOTICE_ASKS)),
    ("official_rule_question", "rag", False, says(*RULE_SUBJECTS) & (_RULED | tight_says(*RULE_TIGHT) | _DROPPED) & ~(says(*ADVICE) & ~(_RULED | _DROPPED))),
    ("urgent_recommendation_rule", "recommended_schedule", True, tight_says(*URGENT) & tight_says(*URGENT_TIMES, *URGENT_SELF)),
    ("recommendation_rule", "recommended_schedule", True, tight_says(*DIRECT) | says(*RECOMMEND) & says(*RECOMMENDED)),
    ("project_explanation_question", "rag", False, tight_says(*PROJECTS) & tight_says(*EXPLAIN) & ~tight_says(*DATE_ONLY)),
    ("weak_subject_rule", "personal_score", True, tight_says(*WEAK) & tight_says(*WEAK_OF)),
    ("personal_risk_rule", "personal_risk", True, says(*SELF, "성적 기준") & (says(*RISKS) | tight_says(*RISKS_TIGHT)) & (says(*RISK_OF) | says("내 상태"))),
    ("bare_risk_rule", "personal_risk", True, tight_says(*BARE_RISK) & tight_says(*BARE_OF)),
    ("personal_score_rule", "personal_score", True, ~says(*OFFICIAL) & _OWN & (says(*SCORES) | tight_says(*SCORES_TIGHT))),
    ("important_context_rule", "important_schedule", True, tight_says(*IMPORTANT_ASKS)),
    ("exam_timeline_rule", "llm_intent", False, _EXAM & tight_says(*PAST) & tight_says(*FUTURE) & says(*SCHEDULES)),
    ("exam_upcoming_rule", "llm_intent", False, _EXAM & tight_says(*EXAM_SOON)),
    ("complex_schedule_rule", "llm_intent", False, says(*PLANNED) & (_ANY_EXCLUDED | tight_says(*(w for _, own in RANKS for w in own)) | says(*PLANNED_KINDS) | tight_says(*ONLY))),
)

# The plans that an intent allows: intent, default route, default sources, allowed sources, allowed routes.
INTENTS = (
    ("schedule_query", "db", ("schedule",), ("schedule", "calendar", "rag"), ("db", "hybrid")),
    ("schedule_recommendation", "hybrid", ("schedule", "risk"), ("schedule", "calendar", "risk", "score", "memory", "user_profile"), ("db", "hybrid")),
    ("important_schedule", "db", ("schedule",), ("schedule", "calendar", "risk", "score"), ("db", "hybrid")),
    ("official_notice_query", "rag", ("notice", "rag"), ("notice", "official_docs", "rag"), ("rag", "hybrid")),
    ("official_rule_query", "rag", ("official_docs", "rag"), ("official_docs", "notice", "rag"), ("rag", "hybrid")),
    ("personal_score_query", "db", ("score", "user_profile"), ("score", "user_profile"), ("db", "hybrid")),
    ("personal_risk_query", "hybrid", ("risk", "score", "schedule"), ("risk", "score", "schedule", "user_profile"), ("db", "hybrid")),
    ("general_development", "llm", (), ("rag", "chat_history"), ("llm", "rag", "hybrid")),
    ("general_chat", "llm", (), ("chat_history", "memory"), ("llm",)),
    ("unknown", "clarify", (), (), ("clarify", "none", "llm")),
)
PLAN_ROUTES = ("db", "rag", "llm", "hybrid", "clarify", "none")
