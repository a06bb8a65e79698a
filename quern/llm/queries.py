"""The registered queries of the numbered operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe_codec, decontaminate, embedding_dedup, lexical_search, lm_score, piece_codec, quality_rules, resample, simhash_dedup, token_counts, toxicity_knn, url_filter, warc
from quern.llm.common import crc_bucket, fresh_folder, prepare, table

URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its similarity and its place in words."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table labels marks documents, not pages: the pages that a given rule decides are the examples."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity_knn.fit(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5) != 0)
    scored = toxicity_knn.score_toxicity(docs, index)
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4, seed=42)
    return found.select("doc_id", simhash_dedup.hexadecimal("fp").alias("fingerprint"), "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), budget=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "budget_chars")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = crc_bucket(F.col("doc_id"), 4) != 2
    sample = quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", usable, quality_rules.SAMPLE)
    scored = quality_rules.score_quality(docs, quality_rules.fit(sample))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents' encoding and its decoding."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    decoded = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) == 2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, whose length and digest are taken anew; revisits from
    headers only."""
    prepare(spark)
    path = fresh_folder(spark, "warc")
    warc.write_warc(warc.archive_pages(table(spark, sf_dir, "pages")), path)
    full = warc.read_warc(spark, path).where(F.col("record_type") == "response")
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("hexed", F.sha1("payload")).withColumn("payload_digest", warc.base32_of("hexed"))
    again = warc.read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    wanted = ["page_id", "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to")]
    first = full.select(*wanted[:-1], F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select(*wanted))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred of the documents, drawn towards the benchmark's distribution of word runs."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    decoded = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), path, end=True).select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_lm_score": op9_lm_score,
    "op10_warc": op10_warc,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES: dict[str, str] = {
    # every window of an item's size, or a shorter document whole, for items of five words or more
    "op1_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
        ), ds AS (
            SELECT doc_id, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS s FROM d WHERE len(w) >= 5
        ), i AS (
            SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
        ), n AS (
            SELECT item_id, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS s FROM i WHERE len(w) >= 5
        ), bag AS (
            SELECT item_id, x, count(*) AS m FROM (SELECT item_id, unnest(s) AS x FROM n) GROUP BY ALL
        ), hits AS (
            SELECT doc_id, item_id, p FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM ds) JOIN bag USING (x)
        ), pairs AS (
            SELECT doc_id, item_id, min(p) AS low, max(p) AS high FROM hits GROUP BY ALL
        ), starts AS (
            SELECT doc_id, item_id, ds.s AS s, len(n.s) AS size, least(len(n.s), len(ds.s)) AS own, unnest(CASE WHEN len(ds.s) < len(n.s) THEN [1] ELSE range(greatest(1, low - len(n.s) + 1), least(high, len(ds.s) - len(n.s) + 1) + 1) END) AS st FROM pairs JOIN n USING (item_id) JOIN ds USING (doc_id)
        ), shingles AS (
            SELECT doc_id, item_id, size, own, st, x, count(*) AS c FROM (SELECT doc_id, item_id, size, own, st, unnest(s[st:st + own - 1]) AS x FROM starts) GROUP BY ALL
        ), alike AS (
            SELECT doc_id, item_id, size, own, st, sum(least(c, m)) AS shared FROM shingles JOIN bag USING (item_id, x) GROUP BY ALL
        ), close_ones AS (
            SELECT doc_id, item_id, own, st, shared / (size + own - shared) AS similarity FROM alike WHERE shared / (size + own - shared) >= 0.8
        )
        SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(st, row(similarity, -st)) - 1 AS start_word, any_value(own) + 4 AS n_words FROM close_ones GROUP BY doc_id, item_id""",
    "op2_url_filter": r"""
        WITH u AS (
            SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), j AS (
            SELECT *, '.' || host AS h, list_filter(list_transform(string_split(path, '/'), lambda x: regexp_replace(lower(x), '[0-9]+', '0', 'g')), lambda x: x <> '') AS segments FROM u
        ), k AS (
            SELECT page_id, url, host, path,
                CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
                CASE WHEN contains(url, '://') THEN list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x), list_transform(segments, lambda x: 'p:' || x),
                    list_transform(regexp_extract_all(url, '[?&]([A-Za-z_]+)=', 1), lambda x: 'q:' || x), ['s:' || split_part(url, '://', 1), 'd:' || len(segments)], CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END)) ELSE [] END AS tokens
            FROM j
        ), m AS (
            SELECT row_number() OVER () AS r, tokens, rule NOT IN ('com/', 'www.example.com/en/') AS bad FROM k WHERE rule IS NOT NULL
        ), e AS (
            SELECT r, bad, unnest(tokens) AS x FROM m
        ), tokens_of AS (
            SELECT min(x) AS x FROM (SELECT x, list(r ORDER BY r) AS pages FROM e GROUP BY x HAVING bool_or(bad)) GROUP BY pages
        ), t AS (
            SELECT r, bad, x FROM e SEMI JOIN tokens_of USING (x)
        ), baskets AS (
            SELECT list(x ORDER BY x) AS own, bad FROM t GROUP BY r, bad
        ), kinds AS (
            SELECT own, bad, count(*) AS n FROM baskets GROUP BY own, bad
        ), sets AS (
            SELECT list_filter(own, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS tokens, bad, n FROM (SELECT own, bad, n, unnest(range(1, 1 << len(own))) AS mask FROM kinds)
        ), counted AS (
            SELECT tokens, sum(n) AS n, coalesce(sum(n) FILTER (bad), 0) AS support, coalesce(sum(n) FILTER (bad), 0) / sum(n) AS confidence FROM sets GROUP BY tokens
        ), frequent AS (
            SELECT * FROM counted WHERE support >= ceil(0.002::DOUBLE * (SELECT count(*) FROM m)) AND support > 0 AND n >= 20
        ), rules AS (
            SELECT *, array_to_string(tokens, ' ') AS mined_rule FROM frequent s
            WHERE confidence >= 0.6 AND support * (SELECT count(*) FILTER (NOT bad) FROM m) >= 3 * (SELECT count(*) FILTER (bad) FROM m) * (n - support) AND (SELECT bool_or(NOT bad) FROM m) AND NOT EXISTS (SELECT 1 FROM frequent p WHERE len(p.tokens) < len(s.tokens) AND list_has_all(s.tokens, p.tokens) AND p.confidence >= s.confidence)
        ), best AS (
            SELECT page_id, arg_max(mined_rule, row(confidence, support, mined_rule)) AS mined_rule, max(confidence) AS confidence FROM k JOIN rules ON list_has_all(k.tokens, rules.tokens) WHERE rule IS NULL GROUP BY page_id
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule, confidence
        FROM k LEFT JOIN best USING (page_id)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (
            SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
        )
        SELECT u AS vec_id, (SELECT count(*) FROM l WHERE l.u = r.u) AS n_links, min(w) AS component_id, u = min(w) AS kept FROM r GROUP BY u""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
        ), b AS (
            SELECT page_id, payload_bytes, hexed, min(page_id) OVER (PARTITION BY hexed) AS first_id FROM p
        ), letters AS (
            SELECT page_id, payload_bytes, hexed, first_id, list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substring(hexed || '0', (i * 5) // 4 + 1, 2))::INTEGER) >> (3 - (i * 5) % 4)) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest FROM b
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM letters""",
    # a feature's crc is folded over its bytes with the table of the 256 steps
    "op11_importance_resampling": r"""
        WITH crc AS (
            SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS steps FROM range(256) t(b)
        ), texts AS (
            SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark
        ), w AS (
            SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
        ), f AS (
            SELECT side, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' ')), list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))) AS feature FROM w
        ), hashed AS (
            SELECT feature, xor(list_reduce(list_transform(range(1, length(digits), 2), lambda i: ('0x' || substring(digits, i, 2))::BIGINT),
                lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT feature, hex(encode(feature)) AS digits FROM f), crc
        ), counted AS (
            SELECT side, bucket, count(*) AS n FROM f JOIN hashed USING (feature) GROUP BY ALL
        ), b AS (
            SELECT range AS bucket, coalesce(any_value(n) FILTER (side = 'd'), 0) AS s, coalesce(any_value(n) FILTER (side = 't'), 0) AS t FROM range(10000) LEFT JOIN counted ON bucket = range GROUP BY range
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM b
        ), weights AS (
            SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
        ), scored AS (
            SELECT r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM w LEFT JOIN weights USING (r) WHERE side = 'd'
        ), places AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (r)""",
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
        ), total AS (
            SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
        ), queries AS (
            SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL
        ), postings AS (
            SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), total
        ), lengths AS (
            SELECT r, doc_id, 75 + (25 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(terms) > 0
        ), scores AS (
            SELECT item_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM queries JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY ALL
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN lengths USING (r) WHERE score > 0) WHERE rank <= 20""",
}
