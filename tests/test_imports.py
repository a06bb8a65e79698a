"""Imports, title keys, chunk details, wrong events and verdicts: cases written by hand, and merging against a loop."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quern.functions import titles, verdicts
from quern.functions.chunks import chunk_rows
from quern.functions.repairs import Wrong, wrong_reasons
from quern.operators import imports

CASES = {
    "[학습] 실습 Q&A": "실습및QNA",
    "실습 및 Q & A": "실습및QNA",
    "QnA 실습 q and a": "실습및QNA",
    "[ Live 방송 ] Web - Basics": "WEBBASICS",
    "web.basics (수정)": "WEBBASICS",
    "Web/basics (예정": "WEBBASICS",
    "Ｗｅｂ　basics": "WEBBASICS",
    "[특강] Web basics": "특강WEBBASICS",
    "Web basics (3": "WEBBASICS",
    "Web basics (3반)": "WEBBASICS3반",
    "3주차 시간표 Web": "3WEB",
    "Kanban and QnAs": "KANBANANDQNAS",
    "": "",
    None: "",
    " . [ ] ": "",
}
SHOWN = {
    "09:00 ~ 10:00 [학습] Web": "Web",
    "[Live 방송] 14:00 JS Basic Syntax 3": "Basic Syntax",
    "[실습 및 Q&A] DB": "실습 Q&A DB",
    "실습 및 Q&A": "실습 Q&A",
    "[특강]   Web ~": "특강] Web",
    "basic syntax 12": "Basic Syntax",
    "9:00": "9:00",
    "x" * 90: "x" * 80,
    "": "",
    None: "",
}


@pytest.mark.parametrize("make, cases", [(titles.title_key, CASES), (titles.display_title, SHOWN)])
def test_titles(spark, make, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "title string")
    assert {r.title: r.made for r in rows.select("title", make(F.col("title")).alias("made")).collect()} == cases


def one_after_the_other(candidates, events, remembered):
    """The loop that the merge stands for."""
    state, count = {}, {}
    for key, number, title, aliases, merged in sorted(events, key=lambda e: e[1]):
        state.setdefault(key, [number, title, list(aliases), list(merged), "merge"])
    touched = {}
    for key, title, name, _ in sorted(candidates, key=lambda c: c[3]):
        count[key] = count.get(key, 0) + 1
        if key not in state:
            state[key] = [None, title or "", [], [], "insert"]
        else:
            event = state[key]
            every = {t for t in [event[1], *event[2], title] if t}
            best = min(every, key=lambda t: (len(t), t)) if every else ""
            event[1], event[2] = best, sorted(every - {best})
            event[3] = (event[3] + [name])[-remembered:]
        touched[key] = state[key]
    return sorted((k, *map(str, v), count[k]) for k, v in touched.items())


@pytest.mark.parametrize("remembered", [1, 3, 20])
def test_merge_is_the_loop(spark, remembered):
    draw = random.Random(remembered)
    names = ["a", "A", "a.", "bb", "a a", "", None]
    candidates = [(f"k{min(draw.randrange(12), draw.randrange(12))}", draw.choice(names), f"c{i}", i) for i in range(160)]
    events = [(f"k{draw.randrange(8)}", 100 - i, draw.choice(["a", "aa", "zz"]), ["old"] * (i % 2), [f"o{n}" for n in range(i)]) for i in range(6)]
    c = spark.createDataFrame(candidates, "key string, title string, candidate string, place int")
    e = spark.createDataFrame(events, "key string, event_id long, title string, aliases array<string>, merged array<string>")
    found = imports.merge_candidates(c.repartition(3), e, ["place"], remembered).collect()
    assert sorted((r.key, str(r.event_id), r.title, str(r.aliases), str(r.merged), r.change, r.n_candidates) for r in found) == one_after_the_other(candidates, events, remembered)


def test_merge_of_nothing_and_into_nothing(spark):
    c = spark.createDataFrame([], "key string, title string, candidate string, place int")
    e = spark.createDataFrame([], "key string, event_id long, title string, aliases array<string>, merged array<string>")
    assert imports.merge_candidates(c, e, ["place"]).collect() == []
    one = spark.createDataFrame([("k", "t", "c", 1)], c.schema)
    assert [tuple(r) for r in imports.merge_candidates(one, e, ["place"]).collect()] == [("k", None, "t", [], [], 1, "insert")]


def test_outcomes_of_items(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", "short"), (4, "b", None), (5, "c", None), (6, "c", "short"), (7, None, None), (8, None, None)]
    items = spark.createDataFrame(rows, "item_id long, content string, why string")
    stored = spark.createDataFrame([("c",), ("c",)], "content string")
    found = {r.item_id: r.outcome for r in imports.item_outcomes(items, F.col("why"), stored).collect()}
    # contents that are not known are compared with none
    assert found == {1: "new", 2: "repeated", 3: "excluded: short", 4: "new", 5: "stored", 6: "excluded: short", 7: "new", 8: "new"}


def test_first_in_order(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "", None), (4, None, 5)], "n int, k string, v int")
    assert sorted(r.n for r in imports.first_in_order(rows, [F.col("k"), F.col("v")], ["n"]).collect()) == [1, 3, 4]


def test_wrong_events(spark):
    day = date(2026, 5, 5)
    wrong = Wrong(("Home",), ("sale",), ("staff",), "with", ("exam",), ("p.m. ) talk",), (date(2026, 1, 31),), ((day, "Children"),), ((date(2026, 1, 7), "proof"),), ("Open", (date(2026, 1, 25),)), ((date(2026, 4, 10), "Meet"),))
    cases = [
        ("Home", "2026-03-01", True, False, ["title"]), ("Home", "2026-03-01", False, False, []), ("Big sale staff", "2026-03-01", True, False, ["word", "ending"]),
        ("with us", "2026-03-01", True, False, ["suspect"]), ("with exam", "2026-03-01", True, False, []), ("x p.m. ) talk", "2026-01-31", True, False, ["phrase", "day"]),
        ("Children", "2026-05-05", True, False, []), ("Other", "2026-05-05", True, False, ["not the day's"]), ("a proof", "2026-01-07", True, False, ["word on a day"]),
        ("Open", "2026-01-25", False, True, ["repeated"]), ("Open", "2026-01-26", True, True, []), ("Meet", "2026-04-10", True, False, ["title on a day"]), ("Meet", None, True, False, []), (None, "2026-05-05", True, True, []),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "title string, day string, read boolean, repaired boolean")
    found = rows.select(wrong_reasons(F.col("title"), F.to_date("day"), F.col("read"), F.col("repaired"), wrong).alias("r")).collect()
    assert [r.r for r in found] == [c[4] for c in cases]
    assert [r.r for r in rows.select(wrong_reasons(F.col("title"), F.to_date("day"), F.col("read"), F.col("repaired"), Wrong()).alias("r")).collect()] == [[]] * len(cases)


def test_chunk_details(spark):
    rows = [(1, 9, "t", "notice", {"start_date": "d", "title": "not this", "note": "n"}, "a"), (2, None, None, "notice", None, "b")]
    d = spark.createDataFrame(rows, "document_id long, raw_id long, title string, document_type string, details map<string,string>, text string")
    first, second = sorted(chunk_rows(d, F.split("text", ",")).collect(), key=lambda r: r.document_id)
    assert first.chunk_id == "1:0" and first.metadata == {
        "document_id": "1", "ai_document_id": "1", "raw_data_id": "9", "document_type": "notice", "source_type": "notice", "event_type": "", "start_date": "d",
        "end_date": "d", "campus": "", "generation": "", "track": "", "title": "t", "chunk_index": "0", "note": "n",
    }
    assert second.metadata["raw_data_id"] is None and second.metadata["end_date"] == "" and len(second.metadata) == 13


def test_classes_and_intents(spark):
    words = verdicts.ClassWords(["Docker"], ["tired"], ["advice"], ["school"], [r"when.*exam", "how many"])
    cases = {"What is docker at school, when is the exam": "general_tech", "I am tired": "general_advice", "School: when is the exam?": "official", "when is the exam?": "unknown", "school advice, how many": "general_advice", "": "unknown", None: "unknown"}
    rows = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.c for r in rows.select("q", verdicts.question_class(F.col("q"), words).alias("c")).collect()} == cases
    routes = [
        ("current_date", "", "unknown", "current_date", 0.98), ("personal_risk", "", "unknown", "personal_risk", 0.9), ("important_schedule", "", "unknown", "schedule_query", 0.88),
        ("schedule_db", "schedule_exact_date", "unknown", "schedule_query", 0.92), ("schedule_db", "schedule_month", "unknown", "schedule_query", 0.84), ("schedule_db", None, "unknown", "schedule_query", 0.74),
        ("rag", "", "general_tech", "official_rag_query", 0.82), ("llm_intent", "", "unknown", "schedule_query", 0.62), ("llm", "", "general_tech", "general_tech", 0.58), (None, None, "general_advice", "general_advice", 0.55), ("llm", "", "official", "unknown", 0.35),
    ]
    rows = spark.createDataFrame([r[:3] for r in routes], "route string, kind string, asked string")
    found = rows.select(verdicts.rule_intent(F.col("route"), F.col("kind"), F.col("asked")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in found] == [r[3:] for r in routes]


def test_search_verdicts(spark):
    rows = spark.createDataFrame([(2, 0, True), (0, 1, True), (0, 0, True), (0, 0, None), (None, None, False)], "n int, m int, exact boolean")
    found = rows.select(verdicts.schedule_verdict(F.col("n"), F.col("m"), F.col("exact")).alias("v")).select("v.status", "v.retry", "v.route").collect()
    assert [tuple(r) for r in found] == [("enough", False, ""), ("partial", False, ""), ("empty", False, ""), ("empty", True, "llm_intent"), ("empty", True, "llm_intent")]
    rows = spark.createDataFrame([(False, "x"), (True, "low"), (True, ""), (None, None)], "bad boolean, why string")
    found = rows.select(verdicts.text_verdict(F.col("bad"), F.col("why")).alias("v")).select("v.status", "v.reason", "v.retry").collect()
    assert [tuple(r) for r in found] == [("enough", "rag_enough_context", False), ("insufficient", "low", True), ("insufficient", "rag_insufficient_context", True), ("insufficient", "rag_insufficient_context", True)]


def test_candidates_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"k{i % 4}", f"t{i % 2}", str(i), i) for i in range(40)], "key string, title string, candidate string, place long")
    events = spark.createDataFrame([], "key string, event_id long, title string, aliases array<string>, merged array<string>")
    found = imports.merge_candidates(rows.mapInArrow(count, rows.schema), events, ["place"]).collect()
    assert [r.n_candidates for r in found] == [10] * 4
    assert seen.value == 40
