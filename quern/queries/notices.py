"""Notices: publication dates and titles by waterfalls over JSON, visibility in the calendar, doubts, duplicates.

Their JSON metadata is made of event numbers, as the test tables hold none of that kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import times
from quern.functions.rules import first_rule
from quern.operators.ranking import first_per_key
from quern.queries import planning
from quern.queries.calendar import HOLIDAYS
from quern.sources.tables import table

# Paths, keys, source types and marks of the surveyed rules.
DATE_PATHS = (
    "list_notice_date", "notice_list_date", "original_notice_date", "board_date", "raw_json.notice.date", "raw_json.notice.reg_date", "raw_json.notice.createdDate", "raw_json.date", "raw_json.reg_date",
    "raw_json.posted_at", "raw_json.published_at", "raw_json.source_date", "notice_date", "published_at", "posted_at", "source_date",
)
TITLE_KEYS = ("title", "subject", "notice_title", "article_title", "board_title", "original_title", "list_title")
GENERIC = ("게시물 목록", "게시물 상세", "공지사항 상세", "멘토 스토리 상세", "상세", "목록", "ACADEMY", "")
NOTICES, HOLIDAY_SOURCES, MANUAL = ("notice", "academy_notice", "announcement"), ("national_holiday", "holiday"), ("manual",)
HIDDEN_SOURCES = ("academic_rule", "academic_rules", "geeknews", "mentor", "mentor_notice", "mentor_story", "mentoring", "mentoring_notice", "mentoring_qna")
HIDDEN_TYPES, HIDDEN_URLS = ("mentoring",), ("mento", "mentor")
CLASS_TYPES = ("click", "view")

#: Metadata of notices, by number; {d} stands for a day, {n} for the number.
FORMS = (
    '{"list_notice_date": "soon", "raw_json": {"notice": {"date": "{d}"}}, "published_at": "1999-01-01"}', '{"raw_json": {"reg_date": "{s}"}, "title": "목록", "raw_json2": 1}', '{"posted_at": "{d}T10:00:00", "raw_json": {"subject": "제목 {n}"}}',
    '{"source_date": "{p}"}', '{"metadata_json": {"list_title": "보드 {n}"}, "notice_date": "none"}', '{"board_date": "{p}", "title": "  ", "subject": "둘째 {n}"}', "{}", '{"raw_json": {"notice": {"createdDate": "{d}"}}, "list_title": "게시물 상세"}',
)
TITLES = ("게시물 목록", "공지 {n}", "수업 상세", "", "공지 상세")
#: Those of the query on titles.
NOTICE_TITLES = ("게시물 목록", "공지 {n}", "수업 상세", "", "ACADEMY")


def notices(spark: SparkSession, sf: str, titles: tuple[str, ...] = TITLES) -> DataFrame:
    n, day = F.col("event_id"), F.to_date("ts")
    e = table(spark, sf, "events").select("event_id", day.alias("day"), F.element_at(F.array(*map(F.lit, FORMS)), (n % len(FORMS) + 1).cast("int")).alias("form"), F.element_at(F.array(*map(F.lit, titles)), (F.floor(n / 8) % len(titles) + 1).cast("int")).alias("t"))
    put = lambda c: F.replace(c, F.lit("{n}"), n.cast("string"))
    full = put(F.col("form"))
    for mark, pattern in (("{d}", "yyyy-MM-dd"), ("{s}", "yyyy/MM/dd"), ("{p}", "yyyy.MM.dd")):
        full = F.replace(full, F.lit(mark), F.date_format("day", pattern))
    return e.select("event_id", full.alias("metadata"), put(F.col("t")).alias("title"))


def publication_date(metadata: F.Column) -> F.Column:
    """The first of sixteen places whose value is a date, with or without a time behind it."""
    values = F.array(*(F.get_json_object(metadata, f"$.{p}") for p in DATE_PATHS))
    parsed = F.transform(values, lambda value: times.first_date(F.substring(F.trim(value), 1, 10)))
    return F.get(F.filter(parsed, lambda day: day.isNotNull()), F.lit(0))


def publication_dates(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).select("event_id", publication_date(F.col("metadata")).alias("published"))


def notice_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title that is not generic: its own, else the first of seven keys in three places, else its own after all."""
    generic = lambda x: x.isin(*GENERIC) | x.endswith("상세")
    own = F.trim("title")
    paths = [f"$.{place}{key}" for place in ("", "raw_json.", "metadata_json.") for key in TITLE_KEYS]
    found = F.filter(F.array(*(F.trim(F.coalesce(F.get_json_object("metadata", p), F.lit(""))) for p in paths)), lambda x: ~generic(x))
    return notices(spark, sf, NOTICE_TITLES).select("event_id", F.when(~generic(own), own).otherwise(F.coalesce(F.get(found, F.lit(0)), own)).alias("title"))


def calendar_visible(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the calendar shows an event: the asker's own and manual ones always; then hidden types, sources and
    addresses never; holidays from holiday sources; then holiday and notice sources."""
    n = F.col("event_id")
    pick = lambda words, step: F.element_at(F.array(*map(F.lit, words)), (F.floor(n / step) % len(words) + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.when(n % 9 == 0, F.col("user_id")).alias("owner_id"), pick(("notice", "mentoring", "holiday", "exam", " Personal "), 1).alias("type"), pick(("notice", "academy_notice", "manual", "holiday", "other", "geeknews"), 5).alias("source"), pick((" Announcement ", "", "", "mentor", "national_holiday"), 3).alias("raw_source"), pick(("http://a/notice", "http://a/MENTOring", ""), 2).alias("url"))
    kind = F.lower(F.trim("type"))
    sources = F.array(F.lower(F.trim("source")), F.lower(F.trim("raw_source")))
    of = lambda words: F.arrays_overlap(F.col("sources"), F.array(*map(F.lit, words)))
    m = e.withColumn("kind", kind).withColumn("sources", sources)
    mine = F.col("owner_id").isNotNull() | of(MANUAL) | (F.col("kind") == "personal")
    step = first_rule(
        [
            (mine, "own"),
            (F.col("kind").isin(*HIDDEN_TYPES), "hidden type"),
            (of(HIDDEN_SOURCES), "hidden source"),
            (F.lower("url").rlike("|".join(HIDDEN_URLS)), "hidden address"),
            ((F.col("kind") == "holiday") & of(HOLIDAY_SOURCES), "holiday"),
            (F.col("kind") == "holiday", "no holiday source"),
            (of(HOLIDAY_SOURCES), "holiday source"),
            (of(NOTICES), "notice source"),
        ],
        "other source",
    )
    return m.select("event_id", step.alias("step")).select("event_id", "step", F.col("step").isin("own", "holiday", "holiday source", "notice source").alias("visible"))


def suspicious_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with reasons to doubt them: six of their own, and two of the groups that they are in (equal titles of one
    day, and mergeable ones of one title and type)."""
    n = F.col("event_id")
    mapping = F.element_at(F.array(*map(F.lit, ("cell", "cell", "fallback_week", "cell", "unknown", "cell"))), (n % 6 + 1).cast("int"))
    e = planning.planned(spark, sf).select("event_id", "day", "event_type", "title", (n % 3 > 0).alias("generated"), mapping.alias("mapping"), F.date_sub("day", (n % 2).cast("int")).alias("published"))
    fixed = F.concat_ws("-", F.month("day"), F.dayofmonth("day")).isin(*(f"{m}-{d}" for m, d in HOLIDAYS))
    e = e.withColumn("merging", (F.col("mapping") == "cell") & (F.col("event_type") == "purchase"))
    # sizes of groups by counting, so that no task holds a whole group
    for name, keys in (("n_same", ["title", "day", "generated"]), ("n_twin", ["title", "event_type", "generated", "merging"])):
        sizes = e.groupBy(*keys).agg(F.count("*").alias(name)).select(*(F.col(k).alias(f"_{k}") for k in keys), name)
        e = e.join(sizes, [e[k].eqNullSafe(sizes[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))
    own = F.col("generated")
    unsure = F.col("mapping").isin("unknown", "fallback_week")
    rules = [
        (own & (F.col("event_type") != "signup") & fixed, "holiday_generated"),
        (own & F.col("event_type").isin(*CLASS_TYPES) & (F.weekday("day") >= 5), "weekend_generated"),
        (F.col("mapping") == "fallback_week", "fallback_week"),
        (F.col("mapping") == "unknown", "unknown_date_source"),
        (unsure & (F.col("published") == F.col("day")), "source_published_at_date"),
        (planning.is_meaningless(F.col("title")), "meaningless_title"),
        (own & (F.col("n_same") > 1), "duplicate_title"),
        (own & F.col("merging") & (F.col("n_twin") > 1), "merge_candidate"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))
    return e.select("event_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def retrieval_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Of events of one canonical title, day, type and track the first by time: titles without marks and spaces, in
    capitals, and those of one kind of project under one name."""
    tight = F.replace(F.upper(F.regexp_replace("title", r"[\s.()_\-/~:\[\]]+", "")), F.lit("PROJECT"), F.lit("PJT"))
    k = F.col("key")
    project = k.contains("관통") & k.rlike("PJT|프로젝트")
    names = [(k.contains("경진대회"), "PROJECT_PJT_CONTEST"), (k.contains("OT"), "PROJECT_PJT_OT"), (k.rlike("제출|마감"), "PROJECT_PJT_DEADLINE"), (k.contains("발표"), "PROJECT_PJT_PRESENTATION")]
    e = planning.planned(spark, sf).withColumn("key", tight).withColumn("key", F.when(project, first_rule(names, "PROJECT_PJT_GENERIC")).otherwise(k))
    track = F.element_at(F.array(*map(F.lit, ("all", "java", "python"))), (F.col("user_id") % 3 + 1).cast("int"))
    return first_per_key(e.withColumn("track", track), ["key", "day", "event_type", "track"], ["ts", "event_id"]).select("event_id", "key", "track")


QUERIES = {f.__name__: f for f in (publication_dates, notice_titles, calendar_visible, suspicious_events, retrieval_dedupe)}

_list, _strings = planning._list, planning._strings
_put = "replace(replace(replace(replace({}, '{{n}}', event_id::VARCHAR), '{{d}}', strftime(ts, '%Y-%m-%d')), '{{s}}', strftime(ts, '%Y/%m/%d')), '{{p}}', strftime(ts, '%Y.%m.%d'))"
_notes = lambda titles: f"n AS (SELECT event_id, {_put.format(f'{_list(FORMS)}[event_id % {len(FORMS)} + 1]')} AS metadata, {_put.format(f'{_list(titles)}[event_id // 8 % {len(titles)} + 1]')} AS title FROM events)"
NOTES = _notes(TITLES)
_date = lambda p: f"coalesce(try_strptime(trim(metadata->>'$.{p}')[:10], ['%Y-%m-%d', '%Y.%m.%d', '%Y/%m/%d', '%Y%m%d'])::DATE)"
_paths = ", ".join(f"trim(coalesce(metadata->>'$.{place}{key}', ''))" for place in ("", "raw_json.", "metadata_json.") for key in TITLE_KEYS)
_key = r"replace(upper(regexp_replace(title, '[\s.()_\-/~:\[\]]+', '', 'g')), 'PROJECT', 'PJT')"

ORACLES = {
    "publication_dates": f"WITH {NOTES} SELECT event_id, coalesce({', '.join(map(_date, DATE_PATHS))}) AS published FROM n",
    "notice_titles": f"WITH {_notes(NOTICE_TITLES)} SELECT event_id, CASE WHEN trim(title) IN {_strings(GENERIC)} OR ends_with(trim(title), '상세') THEN coalesce(list_filter([{_paths}], lambda x: NOT (x IN {_strings(GENERIC)} OR ends_with(x, '상세')))[1], trim(title)) ELSE trim(title) END AS title FROM n",
    "calendar_visible": f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN user_id END AS owner_id, lower(trim(['notice', 'mentoring', 'holiday', 'exam', ' Personal '][event_id % 5 + 1])) AS kind,
            [lower(trim(['notice', 'academy_notice', 'manual', 'holiday', 'other', 'geeknews'][event_id // 5 % 6 + 1])), lower(trim([' Announcement ', '', '', 'mentor', 'national_holiday'][event_id // 3 % 5 + 1]))] AS s, ['http://a/notice', 'http://a/MENTOring', ''][event_id // 2 % 3 + 1] AS url FROM events),
        r AS (SELECT event_id, CASE WHEN owner_id IS NOT NULL OR list_has_any(s, {_list(MANUAL)}) OR kind = 'personal' THEN 'own' WHEN kind = 'mentoring' THEN 'hidden type' WHEN list_has_any(s, {_list(HIDDEN_SOURCES)}) THEN 'hidden source' WHEN contains(lower(url), 'mento') THEN 'hidden address'
            WHEN kind = 'holiday' AND list_has_any(s, {_list(HOLIDAY_SOURCES)}) THEN 'holiday' WHEN kind = 'holiday' THEN 'no holiday source' WHEN list_has_any(s, {_list(HOLIDAY_SOURCES)}) THEN 'holiday source' WHEN list_has_any(s, {_list(NOTICES)}) THEN 'notice source' ELSE 'other source' END AS step FROM e)
        SELECT event_id, step, step IN ('own', 'holiday', 'holiday source', 'notice source') AS visible FROM r""",
    "suspicious_events": rf"""WITH {planning.PLANNED}, c AS (SELECT event_id, day, event_type, title, event_id % 3 > 0 AS generated, ['cell', 'cell', 'fallback_week', 'cell', 'unknown', 'cell'][event_id % 6 + 1] AS mapping, event_id % 2 = 0 AS on_day FROM e),
        g AS (SELECT *, mapping = 'cell' AND event_type = 'purchase' AS merging, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM c), s AS (SELECT *, {planning._short} AS s, count(*) OVER (PARTITION BY title, day, generated) AS n_same, count(*) OVER (PARTITION BY title, event_type, generated, merging) AS n_twin FROM g),
        r AS (SELECT event_id, array_to_string(list_filter([CASE WHEN generated AND event_type <> 'signup' AND (month(day), day(day)) IN ({', '.join(map(str, HOLIDAYS))}) THEN 'holiday_generated' END, CASE WHEN generated AND event_type IN {_strings(CLASS_TYPES)} AND isodow(day) >= 6 THEN 'weekend_generated' END,
            CASE WHEN mapping = 'fallback_week' THEN 'fallback_week' END, CASE WHEN mapping = 'unknown' THEN 'unknown_date_source' END, CASE WHEN mapping <> 'cell' AND on_day THEN 'source_published_at_date' END,
            CASE WHEN s = '' OR regexp_matches(t, '{planning.TIME_RANGE}') OR regexp_matches(t, '{planning.DATE_ONLY}') OR s IN {_strings(planning.MEANINGLESS)} OR starts_with(s, 'HOUSESWAI') OR ends_with(s, 'FORALL') OR (length(s) <= 2 AND s NOT IN {_strings(planning.SHORT)}) THEN 'meaningless_title' END,
            CASE WHEN generated AND n_same > 1 THEN 'duplicate_title' END, CASE WHEN generated AND merging AND n_twin > 1 THEN 'merge_candidate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s) SELECT * FROM r WHERE reasons <> ''""",
    "retrieval_dedupe": f"""WITH {planning.PLANNED}, k AS (SELECT *, {_key} AS k0, ['all', 'java', 'python'][user_id % 3 + 1] AS track FROM e),
        n AS (SELECT *, CASE WHEN contains(k0, '관통') AND regexp_matches(k0, 'PJT|프로젝트') THEN CASE WHEN contains(k0, '경진대회') THEN 'PROJECT_PJT_CONTEST' WHEN contains(k0, 'OT') THEN 'PROJECT_PJT_OT' WHEN regexp_matches(k0, '제출|마감') THEN 'PROJECT_PJT_DEADLINE'
            WHEN contains(k0, '발표') THEN 'PROJECT_PJT_PRESENTATION' ELSE 'PROJECT_PJT_GENERIC' END ELSE k0 END AS key FROM k)
        SELECT event_id, key, track FROM n QUALIFY row_number() OVER (PARTITION BY key, day, event_type, track ORDER BY ts, event_id) = 1""",
}
