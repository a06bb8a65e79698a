"""Text curation: normal forms, fingerprints, masks, chunks, validation, labels, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import texts
from quern.operators.bags import first_sharers
from quern.operators.ranking import first_per_key
from quern.sources.tables import table


def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", texts.fingerprint(F.col("text")).alias("content_hash"))


def dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest id of each normal text; the hash, not the text, is shuffled."""
    d = table(spark, sf, "documents").select("doc_id", texts.fingerprint(F.col("text"), 64).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).select("doc_id", "n_copies")


def prefix_fingerprint_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One message for each pair of 180-character prefixes: its own and the one before it."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(own), F.lit("")))
    key = F.sha2(F.concat_ws("\u0001", F.substring("before", 1, 180), F.substring("text", 1, 180)), 256)
    return first_per_key(c.withColumn("key", key), ["key"], ["conv_id", "turn"]).select("conv_id", "turn")


def repeated_prefix_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many messages repeat an earlier one's first 40 characters, by role."""
    c = table(spark, sf, "conversations").groupBy("role", F.substring(texts.normal_text(F.col("text")), 1, 40).alias("prefix")).agg(F.count("*").alias("n"))
    return c.groupBy("role").agg(F.sum(F.col("n") - 1).alias("n_repeated"), F.count_if(F.col("n") > 1).alias("n_prefixes"))


def pii_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    found = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return d.select("doc_id", found(texts.EMAIL).alias("n_email"), found(texts.PHONE).alias("n_phone"), found(texts.LONG_NUMBER).alias("n_long_number"), F.col("text").rlike(r"(?i)(api[_-]?key|secret|token)\s*[:=]").alias("has_secret"))


def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", texts.mask_personal(F.col("text")).alias("masked"))
    return d.select("doc_id", F.md5("masked").alias("masked_md5"), (F.contains("masked", F.lit("[EMAIL]"))).alias("has_email"))


def boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand in at least five documents are taken out: what is left of each document."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = lines.withColumn("h", F.xxhash64("line"))
    common = marked.where("line <> ''").groupBy("h").agg(F.count_distinct("doc_id").alias("n")).where("n >= 5").select("h", F.lit(True).alias("common"))
    kept = marked.select("doc_id", "h", F.length("line").alias("n")).join(common, "h", "left")
    return kept.groupBy("doc_id").agg(F.count_if(F.col("common").isNull()).alias("n_lines"), F.count_if(F.col("common").isNotNull()).alias("n_removed"), F.coalesce(F.sum(F.when(F.col("common").isNull(), F.col("n"))), F.lit(0)).alias("n_chars"))


def dataset_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a message set: roles, empties, long ones, personal data, broken characters, order."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("role").over(own))
    t = F.coalesce("text", F.lit(""))
    return c.agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("system", "user", "assistant")),
        F.count_if(F.trim(t) == "").alias("n_empty"), F.count_if(F.length(t) > 800).alias("n_long"),
        F.count_if(t.rlike(texts.EMAIL) | t.rlike(texts.PHONE)).alias("n_personal"), F.count_if(F.contains(t, F.lit("�"))).alias("n_broken"),
        F.count_if((F.col("role") == "assistant") & ~F.coalesce(F.col("before") == "user", F.lit(False))).alias("n_unasked"),
    )


def label_join_quality(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.max("n_chars").alias("longest"))


def benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose word bag some document contains to 60 per cent at least: the most contained such pair an item.

    Words are counted and compared where a document is read; a row comes of each number of an item's words that documents share."""
    words = lambda name, key: table(spark, sf, name).select(key, texts.word_tokens(F.col("text")).alias("words"))
    # a little under the share that is rounded to 0.6
    sharers, equal = first_sharers(words("documents", "doc_id"), words("benchmark", "item_id"), "doc_id", "item_id", "words", 0.599)
    shares = sharers.select("doc_id", F.col("item_id").alias("first"), F.round(F.col("shared") / F.col("total"), 6).alias("share")).where("share >= 0.6")
    best = F.min_by("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct(-F.col("share"), F.col("doc_id"))))
    return equal.join(shares.groupBy("first").agg(F.max("share").alias("share"), best.alias("doc_id")), "first").drop("first")


def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer against the user's message before it, as bags of words."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("asked", F.lag("text").over(own)).withColumn("asker", F.lag("role").over(own)).where("role = 'assistant' AND asker = 'user'")
    words = lambda column, n: c.select("conv_id", "turn", F.explode(texts.word_tokens(F.col(column))).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count("*").alias(n))
    both = words("text", "a").join(words("asked", "b"), ["conv_id", "turn", "word"], "full").groupBy("conv_id", "turn").agg(F.sum(F.coalesce(F.least("a", "b").cast("long"), F.lit(0)) * (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")).alias("shared"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    p, r = F.try_divide("shared", "n_a"), F.try_divide("shared", "n_b")
    return both.select("conv_id", "turn", F.coalesce(F.round(F.try_divide(2 * p * r, p + r), 6), F.lit(0.0)).alias("f1"))


def difficulty_label(spark: SparkSession, sf: str) -> DataFrame:
    n, p = F.length("text"), F.size(F.split("text", "\n"))
    kind = F.when((n > 1300) | (p > 12), "hard").when((n > 500) | (p > 5), "medium").otherwise("easy")
    return table(spark, sf, "documents").select("doc_id", kind.alias("difficulty"))


def topic_label(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule whose pattern a text has, and how many rules it has."""
    t = F.lower("text")
    rules = {"table": r"\|", "licence": r"licen[sc]e|copyright", "code": r"def |return |import ", "question": r"\?", "number": r"[0-9]"}
    topic = F.lit("other")
    for name, pattern in reversed(rules.items()):
        topic = F.when(t.rlike(pattern), name).otherwise(topic)
    return table(spark, sf, "documents").select("doc_id", topic.alias("topic"), sum((t.rlike(p).cast("int") for p in rules.values()), F.lit(0)).alias("n_rules"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(texts.paragraph_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return d.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def title_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    """Part names without a leading bracket or colour, punctuation and spaces, in capitals; the parts of each."""
    base = F.regexp_replace("p_name", r"^(\[[^\]]*\]|[a-z]+)\s+", "")
    key = F.upper(F.regexp_replace(base, r"[^\p{L}\p{N}]+", ""))
    return table(spark, sf, "part").groupBy(key.alias("title")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ratio = texts.ascii_ratio(F.col("text"))
    return d.select("doc_id", F.round(ratio, 4).alias("ascii_ratio"), (ratio > 0.97).alias("mostly_ascii"), texts.token_estimate(F.col("text")).alias("n_tokens"), F.length(texts.cut_at_sentence(F.col("text"), 300)).alias("cut_length"))


def summary_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable line of a text, to 200 characters."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 20) & ~x.startswith("http") & ~x.contains("|"))
    d = table(spark, sf, "documents").select("doc_id", F.try_element_at(lines, F.lit(1)).alias("line"))
    return d.select("doc_id", F.when(F.length("line") > 200, F.concat(F.substring("line", 1, 200), F.lit("..."))).otherwise(F.coalesce("line", F.lit(""))).alias("summary"))


def prompt_output_split(spark: SparkSession, sf: str) -> DataFrame:
    """What stands before a conversation's last answer is its prompt; conversations without answers go."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last = F.array_max(F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x["turn"]))
    split = c.withColumn("last", last).where("last IS NOT NULL")
    prompt = F.array_join(F.transform(F.filter("m", lambda x: x["turn"] < F.col("last")), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    output = F.element_at(F.filter("m", lambda x: x["turn"] == F.col("last")), 1)["text"]
    return split.select("conv_id", F.md5(prompt).alias("prompt_md5"), F.length(output).alias("output_chars"))


# -- pages

_TAG_FREE = [(r"(?is)<(script|style|header|footer|nav|aside)\b.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]+>", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")]


def plain_text(html):
    out = html
    for pattern, to in _TAG_FREE:
        out = F.regexp_replace(out, pattern, to) if pattern.startswith("(?") else F.replace(out, F.lit(pattern), F.lit(to))
    return F.trim(F.regexp_replace(out, texts.SPACE, " "))


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of a page without chrome, and a content score: long texts and images count for it."""
    p = table(spark, sf, "pages")
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    body = p.select("page_id", title.alias("title"), plain_text(F.col("html")).alias("text"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("n_links"), F.contains("html", F.lit("<img")).alias("has_image"))
    score = F.length("text") - 80 * F.col("n_links") + F.when(F.col("has_image"), 30).otherwise(0)
    return body.select("page_id", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), score.alias("score"), (score >= 20).alias("real_content"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct link and image targets of a page, made absolute where they start with a slash."""
    p = table(spark, sf, "pages")
    site = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1)))
    absolute = F.transform(found, lambda u: F.when(u.startswith("/"), F.concat(F.col("site"), u)).otherwise(u))
    return p.withColumn("site", site).select("page_id", F.size(found).alias("n_targets"), F.md5(F.array_join(absolute, " ")).alias("targets_md5"))


def url_parts_class(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by host class and kind of path, and how many share host and path with another."""
    p = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1)).alias("host"), F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1).alias("path"), F.contains("url", F.lit("?")).alias("query"))
    cls = F.when(F.col("host").startswith("www."), "www").when(F.col("host").startswith("m."), "mobile").when(F.col("host").startswith("blog."), "blog").otherwise("other")
    kind = F.when(F.col("path").endswith("/"), "list").when(F.col("path").endswith(".html"), "page").otherwise("plain")
    counted = p.withColumn("copies", F.count("*").over(W.partitionBy("host", "path")))
    return counted.groupBy(cls.alias("host_class"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("query")).alias("n_query"), F.count_if(F.col("copies") > 1).alias("n_repeated"))


QUERIES = {
    f.__name__: f
    for f in (
        content_fingerprint, dedupe_exact, prefix_fingerprint_dedupe, repeated_prefix_report, pii_flags, pii_mask, boilerplate_lines, dataset_validate, label_join_quality, benchmark_overlap, token_f1,
        difficulty_label, topic_label, chunk_documents, title_normal_form, noise_flags, summary_candidates, prompt_output_split, html_extract, html_links, url_parts_class,
    )
}

NORMAL = r"trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
MASK = rf"regexp_replace(regexp_replace(regexp_replace(text, '{texts.EMAIL}', '[EMAIL]', 'g'), '{texts.PHONE}', '[PHONE]', 'g'), '{texts.LONG_NUMBER}', '[ID]', 'g')"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

CHUNKS = r"""WITH RECURSIVE t AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS found FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, CASE WHEN len(found) > 0 THEN found ELSE [text] END AS parts FROM t),
        f AS (SELECT doc_id, parts, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS open, 0 AS used FROM p
            UNION ALL
            SELECT doc_id, parts, i + 1, CASE WHEN big THEN list_append(done, closed) ELSE done END, CASE WHEN big THEN [tail, part] ELSE list_append(open, part) END,
                CASE WHEN big THEN length(tail) + length(part) ELSE used + length(part) END
            FROM (SELECT *, right(closed, 120) AS tail, len(open) > 0 AND used + length(part) > 800 AS big FROM
                (SELECT *, array_to_string(open, chr(10) || chr(10)) AS closed, parts[i + 1] AS part FROM f WHERE i < len(parts)))),
        e AS (SELECT doc_id, list_append(done, array_to_string(open, chr(10) || chr(10))) AS chunks FROM f WHERE i = len(parts))"""

_html = "html"
for _pattern, _to in [(r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<header\b.*?</header>", " "), (r"(?is)<footer\b.*?</footer>", " "), (r"(?is)<nav\b.*?</nav>", " "), (r"(?is)<aside\b.*?</aside>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]+>", " ")]:
    _html = f"regexp_replace({_html}, '{_pattern}', '{_to}', 'g')"
for _pattern, _to in _TAG_FREE[3:]:
    _html = f"replace({_html}, '{_pattern}', '{_to}')"
_html = rf"trim(regexp_replace({_html}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"

ORACLES = {
    "content_fingerprint": f"SELECT doc_id, CASE WHEN {NORMAL} = '' THEN '' ELSE left(sha256({NORMAL}), 16) END AS content_hash FROM documents",
    "dedupe_exact": f"SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY {NORMAL}",
    "prefix_fingerprint_dedupe": """WITH b AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)
        SELECT conv_id, turn FROM b QUALIFY row_number() OVER (PARTITION BY left(before, 180), left(text, 180) ORDER BY conv_id, turn) = 1""",
    "repeated_prefix_report": f"""SELECT role, sum(n - 1)::BIGINT AS n_repeated, count(*) FILTER (n > 1) AS n_prefixes
        FROM (SELECT role, left({NORMAL}, 40) AS prefix, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY role""",
    "pii_flags": rf"""SELECT doc_id, len(regexp_extract_all(text, '{texts.EMAIL}')) AS n_email, len(regexp_extract_all(text, '{texts.PHONE}')) AS n_phone,
        len(regexp_extract_all(text, '{texts.LONG_NUMBER}')) AS n_long_number, regexp_matches(text, '(?i)(api[_-]?key|secret|token)\s*[:=]') AS has_secret FROM documents""",
    "pii_mask": f"SELECT doc_id, md5({MASK}) AS masked_md5, contains({MASK}, '[EMAIL]') AS has_email FROM documents",
    "boilerplate_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) FILTER (c.line IS NULL) AS n_lines, count(*) FILTER (c.line IS NOT NULL) AS n_removed, coalesce(sum(length(l.line)) FILTER (c.line IS NULL), 0)::BIGINT AS n_chars
        FROM l LEFT JOIN c USING (line) GROUP BY doc_id""",
    "dataset_validate": f"""WITH b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, coalesce(text, '') AS t FROM conversations)
        SELECT count(*) AS n, count(*) FILTER (role = 'system') AS n_system, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
        count(*) FILTER (trim(t) = '') AS n_empty, count(*) FILTER (length(t) > 800) AS n_long, count(*) FILTER (regexp_matches(t, '{texts.EMAIL}') OR regexp_matches(t, '{texts.PHONE}')) AS n_personal,
        count(*) FILTER (contains(t, chr(65533))) AS n_broken, count(*) FILTER (role = 'assistant' AND NOT coalesce(before = 'user', false)) AS n_unasked FROM b""",
    "label_join_quality": """SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, max(n_chars) AS longest FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "benchmark_overlap": f"""WITH i AS (SELECT item_id, word, count(*) AS m FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS word FROM benchmark) GROUP BY ALL),
        d AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS word FROM documents) GROUP BY ALL),
        p AS (SELECT doc_id, item_id, round(sum(least(n, m)) / any_value(total), 6) AS share FROM d JOIN i USING (word) JOIN (SELECT item_id, sum(m) AS total FROM i GROUP BY 1) USING (item_id) GROUP BY ALL)
        SELECT item_id, max(share) AS share, arg_min(doc_id, row(-share, doc_id)) AS doc_id FROM p WHERE share >= 0.6 GROUP BY item_id""",
    "token_f1": f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER w AS asked, role, lag(role) OVER w AS asker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        q AS (SELECT * FROM c WHERE role = 'assistant' AND asker = 'user'),
        a AS (SELECT conv_id, turn, word, count(*) AS a FROM (SELECT conv_id, turn, unnest({TOKENS.format('text')}) AS word FROM q) GROUP BY ALL),
        b AS (SELECT conv_id, turn, word, count(*) AS b FROM (SELECT conv_id, turn, unnest({TOKENS.format('asked')}) AS word FROM q) GROUP BY ALL),
        s AS (SELECT conv_id, turn, sum(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE least(a, b) END) AS shared, sum(a) AS n_a, sum(b) AS n_b FROM a FULL JOIN b USING (conv_id, turn, word) GROUP BY ALL)
        SELECT conv_id, turn, coalesce(round(CASE WHEN shared > 0 THEN 2 * (shared / n_a) * (shared / n_b) / (shared / n_a + shared / n_b) END, 6), 0.0) AS f1 FROM s""",
    "difficulty_label": """SELECT doc_id, CASE WHEN length(text) > 1300 OR len(string_split(text, chr(10))) > 12 THEN 'hard' WHEN length(text) > 500 OR len(string_split(text, chr(10))) > 5 THEN 'medium' ELSE 'easy' END AS difficulty FROM documents""",
    "topic_label": r"""WITH f AS (SELECT doc_id, regexp_matches(lower(text), '\|') AS a, regexp_matches(lower(text), 'licen[sc]e|copyright') AS b, regexp_matches(lower(text), 'def |return |import ') AS c,
        regexp_matches(lower(text), '\?') AS d, regexp_matches(lower(text), '[0-9]') AS e FROM documents)
        SELECT doc_id, CASE WHEN a THEN 'table' WHEN b THEN 'licence' WHEN c THEN 'code' WHEN d THEN 'question' WHEN e THEN 'number' ELSE 'other' END AS topic, a::INT + b::INT + c::INT + d::INT + e::INT AS n_rules FROM f""",
    "chunk_documents": CHUNKS + """, u AS (SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_no, unnest(chunks) AS chunk FROM e)
        SELECT doc_id, chunk_no::INT AS chunk_no, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM u""",
    "title_normal_form": r"""SELECT upper(regexp_replace(regexp_replace(p_name, '^(\[[^\]]*\]|[a-z]+)\s+', ''), '[^\p{L}\p{N}]+', '', 'g')) AS title, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""",
    "noise_flags": r"""WITH r AS (SELECT doc_id, text, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / nullif(length(text), 0) AS ratio, left(text, 300) AS head FROM documents)
        SELECT doc_id, round(ratio, 4) AS ascii_ratio, ratio > 0.97 AS mostly_ascii, greatest(1, length(text) // 4) AS n_tokens,
        CASE WHEN length(text) <= 300 THEN length(text) WHEN contains(head, '.') THEN 300 - instr(reverse(head), '.') + 1 ELSE 300 END AS cut_length FROM r""",
    "summary_candidates": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT starts_with(x, 'http') AND NOT contains(x, '|'))[1] AS line FROM documents)
        SELECT doc_id, CASE WHEN length(line) > 200 THEN left(line, 200) || '...' ELSE coalesce(line, '') END AS summary FROM l""",
    "prompt_output_split": """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT c.conv_id, md5(coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (turn < last), '')) AS prompt_md5, length(any_value(text) FILTER (turn = last)) AS output_chars
        FROM conversations c JOIN l USING (conv_id) GROUP BY c.conv_id""",
    "html_extract": rf"""WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, {_html} AS text, len(regexp_extract_all(html, '(?i)<a\s')) AS n_links, contains(html, '<img') AS img FROM pages),
        s AS (SELECT *, length(text) - 80 * n_links + CASE WHEN img THEN 30 ELSE 0 END AS score FROM t)
        SELECT page_id, md5(title) AS title_md5, md5(text) AS text_md5, length(text) AS n_chars, score, score >= 20 AS real_content FROM s""",
    "html_links": r"""WITH t AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) AS found FROM pages),
        d AS (SELECT page_id, site, list_filter(found, lambda x, i: list_position(found, x) = i) AS u FROM t)
        SELECT page_id, len(u) AS n_targets, md5(array_to_string(list_transform(u, lambda x: CASE WHEN starts_with(x, '/') THEN site || x ELSE x END), ' ')) AS targets_md5 FROM d""",
    "url_parts_class": r"""WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, contains(url, '?') AS query FROM pages),
        c AS (SELECT *, count(*) OVER (PARTITION BY host, path) AS copies FROM p)
        SELECT CASE WHEN starts_with(host, 'www.') THEN 'www' WHEN starts_with(host, 'm.') THEN 'mobile' WHEN starts_with(host, 'blog.') THEN 'blog' ELSE 'other' END AS host_class,
        CASE WHEN ends_with(path, '/') THEN 'list' WHEN ends_with(path, '.html') THEN 'page' ELSE 'plain' END AS kind, count(*) AS n, count(*) FILTER (query) AS n_query, count(*) FILTER (copies > 1) AS n_repeated FROM c GROUP BY ALL""",
}
