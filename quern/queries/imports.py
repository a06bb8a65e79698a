"""Imports with parsing and merging, keys of titles, chunks with their details, and verdicts of searches, over the tables' texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import texts, titles, verdicts
from quern.functions.chunks import chunk_rows
from quern.functions.repairs import Wrong, wrong_reasons
from quern.functions.rules import first_rule
from quern.operators import imports
from quern.queries.text import CHUNKS, NORMAL
from quern.sources.tables import table

#: Words of the tables' own languages and sources for the titles made of their lines.
WORDS = titles.TitleWords(labels=("de", "fr"), noise=("es", "fr"), statuses=("src1", "src2", "src3"), wrappers=("the", "der"), live=("In", "in"))
CLASSES = verdicts.ClassWords(technical=("tion de", "ing the"), moods=("schlich", "heaux"), advice=("ment la", "ar el"), domain=("der", "the", "que"), facts=(r"(und|la) .*\.", "^the "))


def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of first lines with their language before and their source behind them, and the documents of each."""
    line = F.substring_index("text", "\n", 1)
    title = F.concat(F.lit("["), "lang", F.lit("] "), line, F.lit(" ("), "source", F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", titles.title_key(title, WORDS).alias("title_key")).groupBy("title_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def shown_titles(spark: SparkSession, sf: str) -> DataFrame:
    """First lines as titles to show, some with times and a label before them."""
    line = F.substring_index("text", "\n", 1)
    times = F.when(F.col("n_chars") % 3 == 0, F.lit("9:30 ~ 11:00 ")).when(F.col("n_chars") % 3 == 1, F.lit("14 : 00 ")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", titles.display_title(F.concat(times, F.lit("["), "lang", F.lit("]  "), line), WORDS).alias("title"))


def _lines(documents: DataFrame) -> DataFrame:
    """A document's lines as candidates for titles."""
    return documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("place", "line")).select("doc_id", "place", "source", "lang", F.trim("line").alias("title"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.length("title") % 28).withColumn("name", titles.title_key(F.col("title"), WORDS)).where("name <> ''").withColumn("key", imports.key_of("name", "day", "source", "lang"))


def import_events(spark: SparkSession, sf: str) -> DataFrame:
    """Documents imported: the first of each content that is not too short is read, each of its lines is a title unless it
    is blank, a table's or too long, and titles of one key, length, source and language are one event. Labelled documents'
    first lines are stored as events before, in capitals."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "text", texts.fingerprint(F.col("text"), 64).alias("content"))
    none = spark.createDataFrame([], "content string")
    short = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 60, "too short")
    new = imports.item_outcomes(d, short, none, "doc_id").where("outcome = 'new'")
    read = _lines(new).where((F.col("title") != "") & ~F.contains("title", F.lit("|")) & (F.length("title") <= 200))
    candidates = _keyed(read).withColumn("candidate", F.concat_ws(":", "doc_id", "place"))
    known = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    stored = _keyed(known.select("doc_id", "source", "lang", F.upper(F.trim(F.substring_index("text", "\n", 1))).alias("title")))
    empty = F.array().cast("array<string>")
    events = stored.select("key", F.col("doc_id").alias("event_id"), "title", empty.alias("aliases"), empty.alias("merged"))
    found = imports.merge_candidates(candidates, events, ["doc_id", "place"])
    return found.select("event_id", "title", F.array_join("aliases", "|").alias("aliases"), F.array_join("merged", ",").alias("merged"), "n_candidates", "change")


def import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each document of an import into a store that has the labelled ones."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", texts.fingerprint(F.col("text"), 64).alias("content"))
    stored = d.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    reason = first_rule([(F.length(F.trim(F.coalesce("text", F.lit("")))) < 60, "too short"), (F.regexp_count("text", F.lit(r"\|")) > 20, "table")], None).cast("string")
    return imports.item_outcomes(d, reason, stored, "doc_id").select("doc_id", "first_item", "outcome")


def parsed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as read events: those of a grid's parser are the same by title key and day, others by title and time; the
    first of each stays."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.concat(F.lit("[de] "), F.lower("o_orderpriority")).alias("title"), "o_orderdate")
    grid = F.col("o_orderstatus") != "O"
    marked = o.withColumn("name", F.when(grid, titles.title_key(F.col("title"), WORDS)).otherwise(F.col("title"))).withColumn("at", F.when(grid, F.to_date("o_orderdate").cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp")))
    return imports.first_in_order(marked, [F.col("name"), F.col("at"), F.col("o_custkey") % 5], ["o_orderkey"]).select("o_orderkey", "name")


def sorted_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one user and day, of which the first by kind, value and number stays."""
    kind = first_rule([(F.col("event_type") == k, i) for i, k in enumerate(("purchase", "signup", "error"))], 99)
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value", kind.alias("priority"))
    return imports.first_in_order(e, [F.col("user_id"), F.col("day")], ["priority", "value", "event_id"]).select("user_id", "day", "event_id", "event_type")


DAY = date(2026, 1, 1)
WRONG = Wrong(
    titles=("To oned onerntat thatthtieror.",), words=("%%%", "###"), endings=("thanea.", "la."), suspect="ing", unless=("the", "The"), phrases=("de la", "und der"), days=(date(2026, 1, 31), date(2026, 2, 2)),
    only=((date(2026, 2, 5), "In in oredble ea."),), never=((date(2026, 1, 7), "the"),), repeated=("In in oredble ea.", (date(2026, 1, 18), date(2026, 2, 5))), exactly=((date(2026, 2, 8), "And therhean is the is esndha reedes ha."),),
)


def wrong_events(spark: SparkSession, sf: str) -> DataFrame:
    """First lines as titles on a day of their length that a reading should not have made, each once with all reasons."""
    line = F.substring_index("text", "\n", 1)
    day = F.date_add(F.lit(DAY), (F.length(line) % 120).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", wrong_reasons(line, day, F.col("source") != "src0", (F.col("source") == "src0") & (F.col("lang") == "en"), WRONG).alias("reasons"))
    return d.where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def chunk_details(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' chunks with all that they carry of their document, in the order of the names."""
    details = F.map_filter(F.create_map(F.lit("track"), F.col("lang"), F.lit("start_date"), F.when(F.col("lang") == "en", "2026-01-05"), F.lit("source_type"), F.when(F.col("lang") != "de", F.col("source")), F.lit("chunk_index"), F.lit("own"), F.lit("note"), F.lit("n")), lambda _, v: v.isNotNull())
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") + 7).alias("raw_id"), F.substring("text", 1, 20).alias("title"), F.concat(F.lit("text_"), "lang").alias("document_type"), "text", details.alias("details"))
    found = chunk_rows(d, texts.paragraph_chunks(F.col("text")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.select("chunk_id", F.md5("content").alias("content_md5"), F.md5(listed).alias("metadata_md5"), F.size("metadata").alias("n_details"))


def question_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What users' messages are about, and the intent and confidence of rules for those on no verified route."""
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", verdicts.question_class(F.col("text"), CLASSES).alias("class"))
    return c.withColumn("r", verdicts.rule_intent(F.lit("llm"), F.lit(""), F.col("class"))).select("conv_id", "turn", "class", "r.intent", "r.confidence")


def search_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' urgent orders as rows of a search, orders not specified as rows of a wider one; odd customers ask for one day."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n"), F.count(F.when(F.col("o_orderpriority").startswith("4"), 1)).alias("m"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    n = lambda name: F.coalesce(name, F.lit(0))
    return c.select("c_custkey", verdicts.schedule_verdict(n("n"), n("m"), F.col("c_custkey") % 2 == 1).alias("v")).select("c_custkey", "v.*")


QUERIES = {f.__name__: f for f in (title_keys, shown_titles, import_events, import_outcomes, parsed_duplicates, sorted_duplicates, wrong_events, chunk_details, question_classes, search_verdicts)}

_LINE = "string_split(text, chr(10))[1]"


def _key(title: str) -> str:
    out = rf"trim(regexp_replace({title}, '\s+', ' ', 'g'))"
    for pattern, to in ((r"^\s*\[(de|fr)\]\s*", ""), (r"(?i)^\s*\[?\s*in\s*in\s*\]?\s*", ""), (r"\s*\((src1|src2|src3)\)?", ""), (r"\s*\([^)]{1,2}$", ""), ("(the|der)", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return rf"upper(replace(regexp_replace({out}, '[][\s.:/_()-]+', '', 'g'), 'ß', 'SS'))"


_SHOWN = rf"regexp_replace({_LINE}, '^\s+|\s+$', '', 'g')"
_SHORT = "length(trim(coalesce(text, ''), ' ')) < 60"
ORACLES = {
    "title_keys": f"SELECT {_key(f'''('[' || lang || '] ' || {_LINE} || ' (' || source || ')')''')} AS title_key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "shown_titles": rf"""WITH t AS (SELECT doc_id, lang, trim(regexp_replace({_LINE}, '\s+', ' ', 'g')) AS line FROM documents),
        s AS (SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN regexp_replace(line, '(?i)^\s*\[?\s*in\s*in\s*\]?\s*', '') ELSE '[' || lang || '] ' || line END AS line FROM t)
        SELECT doc_id, left(regexp_replace(line, '^[] :|[()~-]+|[] :|[()~-]+$', '', 'g'), 80) AS title FROM s""",
    "import_events": f"""WITH n AS (SELECT doc_id, source, lang, text FROM documents WHERE NOT {_SHORT} QUALIFY row_number() OVER (PARTITION BY {NORMAL} ORDER BY doc_id) = 1),
        l AS (SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, trim(unnest(string_split(text, chr(10))), ' ') AS title FROM n),
        c AS (SELECT *, length(title) % 28 AS day, {_key('title')} AS name FROM l WHERE title <> '' AND NOT contains(title, '|') AND length(title) <= 200),
        u AS (SELECT doc_id AS event_id, source, lang, upper(replace(trim({_LINE}, ' '), 'ß', 'SS')) AS title FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
        s AS (SELECT *, length(title) % 28 AS day, {_key('title')} AS name FROM u QUALIFY row_number() OVER (PARTITION BY name, day, source, lang ORDER BY event_id) = 1),
        m AS (SELECT c.*, event_id, s.title AS old, row_number() OVER w AS r, count(*) OVER (PARTITION BY name, day, source, lang) AS n
            FROM c LEFT JOIN s USING (name, day, source, lang) WHERE name <> '' WINDOW w AS (PARTITION BY name, day, source, lang ORDER BY doc_id, place)),
        g AS (SELECT any_value(event_id) AS event_id, any_value(n) AS n_candidates, list_sort(list_distinct(list_transform(list_append(list(title), any_value(old)), lambda t: {{'n': length(t), 't': t}}))) AS t,
            coalesce(string_agg(doc_id || ':' || place, ',' ORDER BY r) FILTER (r > n - 20 AND (event_id IS NOT NULL OR r > 1)), '') AS merged FROM m GROUP BY name, day, source, lang)
        SELECT event_id, list_filter(t, lambda x: x.t IS NOT NULL)[1].t AS title, array_to_string(list_sort(list_transform(list_filter(t, lambda x: x.t IS NOT NULL)[2:], lambda x: x.t)), '|') AS aliases, merged, n_candidates,
            CASE WHEN event_id IS NULL THEN 'insert' ELSE 'merge' END AS change FROM g""",
    "import_outcomes": rf"""WITH d AS (SELECT doc_id, {NORMAL} AS h, CASE WHEN {_SHORT} THEN 'too short' WHEN len(regexp_extract_all(text, '\|')) > 20 THEN 'table' END AS reason FROM documents),
        f AS (SELECT h, min(doc_id) AS first_item FROM d WHERE reason IS NULL GROUP BY h), s AS (SELECT DISTINCT h FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT doc_id, first_item, CASE WHEN reason IS NOT NULL THEN 'excluded: ' || reason WHEN h IN (SELECT h FROM s) THEN 'stored' WHEN doc_id <> first_item THEN 'repeated' ELSE 'new' END AS outcome FROM d LEFT JOIN f USING (h)""",
    "parsed_duplicates": """WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN upper(regexp_replace(o_orderpriority, '[ -]+', '', 'g')) ELSE '[de] ' || lower(o_orderpriority) END AS name,
            CASE WHEN o_orderstatus <> 'O' THEN date_trunc('day', o_orderdate) ELSE o_orderdate END AS moment FROM orders)
        SELECT min(o_orderkey) AS o_orderkey, name FROM o GROUP BY name, moment, o_custkey % 5""",
    "sorted_duplicates": """SELECT user_id, ts::DATE AS day, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 99 END, value NULLS FIRST, event_id) = 1""",
    "wrong_events": f"""WITH t AS (SELECT doc_id, source, lang, {_LINE} AS t, (DATE '2026-01-01' + (length({_LINE}) % 120)::INT)::VARCHAR AS day FROM documents),
        r AS (SELECT doc_id, concat_ws(',', CASE WHEN t = 'To oned onerntat thatthtieror.' THEN 'title' END, CASE WHEN t LIKE '%\\%\\%\\%%' ESCAPE '\\' OR t LIKE '%###%' THEN 'word' END, CASE WHEN t LIKE '%thanea.' OR t LIKE '%la.' THEN 'ending' END,
            CASE WHEN t LIKE '%ing%' AND t NOT LIKE '%the%' AND t NOT LIKE '%The%' THEN 'suspect' END, CASE WHEN t LIKE '%de la%' OR t LIKE '%und der%' THEN 'phrase' END, CASE WHEN day IN ('2026-01-31', '2026-02-02') THEN 'day' END,
            CASE WHEN day = '2026-02-05' AND t <> 'In in oredble ea.' THEN 'not the day''s' END, CASE WHEN day = '2026-01-07' AND t LIKE '%the%' THEN 'word on a day' END, CASE WHEN t = 'In in oredble ea.' AND day IN ('2026-01-18', '2026-02-05') THEN 'repeated' END,
            CASE WHEN day = '2026-02-08' AND t = 'And therhean is the is esndha reedes ha.' THEN 'title on a day' END) AS reasons FROM t WHERE source <> 'src0'
            UNION ALL SELECT doc_id, 'repeated' FROM t WHERE source = 'src0' AND lang = 'en' AND t = 'In in oredble ea.' AND day IN ('2026-01-18', '2026-02-05'))
        SELECT * FROM r WHERE reasons <> ''""",
    "chunk_details": CHUNKS + """, c AS (SELECT doc_id, unnest(chunks) AS content, generate_subscripts(chunks, 1) - 1 AS i FROM e)
        SELECT doc_id || ':' || i AS chunk_id, md5(content) AS content_md5, 14 AS n_details, md5('ai_document_id=' || doc_id || '|campus=|chunk_index=' || i || '|document_id=' || doc_id || '|document_type=text_' || lang || '|end_date=' || s || '|event_type=|generation=|note=n|raw_data_id=' || (doc_id + 7)
            || '|source_type=' || CASE lang WHEN 'de' THEN 'text_de' ELSE source END || '|start_date=' || s || '|title=' || left(text, 20) || '|track=' || lang) AS metadata_md5
        FROM c JOIN (SELECT *, CASE lang WHEN 'en' THEN '2026-01-05' ELSE '' END AS s FROM documents) USING (doc_id)""",
    "question_classes": r"""WITH c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'tion de|ing the') THEN 'general_tech' WHEN regexp_matches(lower(text), 'schlich|heaux|ment la|ar el') THEN 'general_advice'
            WHEN regexp_matches(lower(text), 'der|the|que') AND regexp_matches(lower(text), '(und|la) .*\.|^the ') THEN 'official' ELSE 'unknown' END AS class FROM conversations WHERE role = 'user')
        SELECT *, CASE class WHEN 'official' THEN 'unknown' ELSE class END AS intent, CASE class WHEN 'general_tech' THEN 0.58 WHEN 'general_advice' THEN 0.55 ELSE 0.35 END::DOUBLE AS confidence FROM c""",
    "search_verdicts": """WITH o AS (SELECT c_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, count(*) FILTER (o_orderpriority LIKE '4%') AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT c_custkey, CASE WHEN n > 0 THEN 'enough' WHEN m > 0 THEN 'partial' ELSE 'empty' END AS status,
            CASE WHEN n > 0 THEN 'schedule_rows_found' WHEN m > 0 THEN 'fallback_schedule_rows_found' WHEN c_custkey % 2 = 1 THEN 'exact_date_no_rows' ELSE 'schedule_no_rows' END AS reason,
            n = 0 AND m = 0 AND c_custkey % 2 = 0 AS retry, CASE WHEN n = 0 AND m = 0 AND c_custkey % 2 = 0 THEN 'llm_intent' ELSE '' END AS route FROM o""",
}
