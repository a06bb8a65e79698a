"""What a question is about, how sure rules are of it, and whether what was found will do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.rules import first_rule


@dataclass(frozen=True)
class ClassWords:
    """Words of technical questions, of moods, of advice and of the institution, and patterns of questions for its facts."""

    technical: Sequence[str]
    moods: Sequence[str]
    advice: Sequence[str]
    domain: Sequence[str]
    facts: Sequence[str]


def question_class(question: Column, words: ClassWords) -> Column:
    """general_tech, general_advice, official or unknown: the first class that fits a question in lower case; an official
    one names the institution and asks for a fact. Null is unknown."""
    text = F.lower(F.trim(question))

    def named(terms: Sequence[str]) -> Column:
        return F.exists(F.array(*map(F.lit, [t.lower() for t in terms])), lambda t: F.contains(text, t)) if terms else F.lit(False)

    fact = text.rlike("|".join(f"(?:{p})" for p in words.facts)) if words.facts else F.lit(False)
    return first_rule([(named(words.technical), "general_tech"), (named([*words.moods, *words.advice]), "general_advice"), (named(words.domain) & fact, "official")], "unknown")


# Intents and confidences of the surveyed routes and classes. A route of None keeps its own name.
ROUTES = (
    (("current_date",), "current_date", 0.98),
    (("personal_score", "personal_risk", "recommended_schedule"), None, 0.9),
    (("important_schedule",), "schedule_query", 0.88),
    (("rag",), "official_rag_query", 0.82),
    (("llm_intent",), "schedule_query", 0.62),
)
SCHEDULES = ((("schedule_exact_date",), 0.92), (("schedule_range", "schedule_month"), 0.84))
SCHEDULE_LEFT = 0.74
CLASSES = (("general_tech", 0.58), ("general_advice", 0.55))
LEFT = ("unknown", 0.35)


def rule_intent(route: Column, query_type: Column, asked: Column) -> Column:
    """struct<intent, confidence>: by the route, a schedule's by its kind of range, and where no route fits by the class."""
    schedule = first_rule([(query_type.isin(*kinds), value) for kinds, value in SCHEDULES], SCHEDULE_LEFT)
    rules = [(route.isin(*names), F.struct((route if intent is None else F.lit(intent)).alias("intent"), F.lit(value).alias("confidence"))) for names, intent, value in ROUTES]
    rules.append((route == "schedule_db", F.struct(F.lit("schedule_query").alias("intent"), schedule.alias("confidence"))))
    rules += [(asked == name, F.struct(F.lit(name).alias("intent"), F.lit(value).alias("confidence"))) for name, value in CLASSES]
    return first_rule(rules, F.struct(F.lit(LEFT[0]).alias("intent"), F.lit(LEFT[1]).alias("confidence")))


def schedule_verdict(rows: Column, fallback_rows: Column, exact: Column) -> Column:
    """struct<status, reason, retry, route> of a search for planned events: rows, else rows of the wider search, else nothing, which
    for one named day is final and else is tried again by another route. Null counts are 0, a null flag is not exact."""
    made = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("status", "reason", "retry", "route"))))
    return first_rule([(rows > 0, made("enough", "schedule_rows_found", False, "")), (fallback_rows > 0, made("partial", "fallback_schedule_rows_found", False, "")), (exact, made("empty", "exact_date_no_rows", False, ""))], made("empty", "schedule_no_rows", True, "llm_intent"))


def text_verdict(insufficient: Column, reason: Column) -> Column:
    """The same of a search in texts; a null flag is insufficient."""
    made = lambda status, why, retry, route: F.struct(F.lit(status).alias("status"), why.alias("reason"), F.lit(retry).alias("retry"), F.lit(route).alias("route"))
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit("rag_insufficient_context"))
    return F.when(~insufficient, made("enough", F.lit("rag_enough_context"), False, "")).otherwise(made("insufficient", why, True, "llm_intent"))
