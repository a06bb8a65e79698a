"""Retrieval: exact vector search, lexical and metadata search, merging, reranking, sufficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import texts
from quern.functions.vectors import cosine
from quern.operators import partitions
from quern.operators.ranking import first_per_key
from quern.plans import retrieval as plan
from quern.sources.tables import table

TERMS = ["the", "Thand", "eaux", "ich", "con", "idiot", "license"]

#: Texts of a partition whose words are summed in it, about.
TEXTS = 2000


def _nearest(spark: SparkSession, sf: str, k: int, condition: str = "true") -> DataFrame:
    """The k best by cosine to vector 0, then only the positive: the order of the two matters."""
    vectors = table(spark, sf, "embeddings").where(condition)
    query = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vectors.join(F.broadcast(query)).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 4).alias("score"))  # one query vector
    return scored.orderBy(F.desc("score"), "vec_id").limit(k).where("score > 0")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 10).select("vec_id", "score")


def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A missing label passes the filter, as an equal one does."""
    return _nearest(spark, sf, 20, "label IS NULL OR label = 3")


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.least(F.lit(1.0), F.lit(0.1) * texts.term_hits(F.col("text"), TERMS)).alias("score"))


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 4).alias("score"))


def metadata_search(spark: SparkSession, sf: str) -> DataFrame:
    """Blank metadata passes; of two keys both must fit; the unranked score is 1."""
    d = table(spark, sf, "documents")
    fits = lambda key, value: F.coalesce(F.trim(key), F.lit("")).isin("", value)
    return d.where(fits("lang", "de") & fits("source", "src0")).select("doc_id", F.lit(1.0).alias("score"))


def rerank_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Of the 50 lexical hits, 0.08 more for each query term in the text, at most 1; the best three."""
    hits = lexical_search(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "text")
    boosted = F.round(F.least(F.lit(1.0), F.col("score") + F.lit(0.08) * texts.term_hits(F.col("text"), ["that", "with", "eau"])), 4)
    return d.join(F.broadcast(hits), "doc_id").select("doc_id", boosted.alias("score")).orderBy(F.desc("score"), "doc_id").limit(3)


def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and lexical hits by id, each with its better score."""
    vector = _nearest(spark, sf, 40).select(F.col("vec_id").alias("doc_id"), "score")
    both = vector.withColumn("way", F.lit("vector")).unionByName(lexical_search(spark, sf).withColumn("way", F.lit("lexical")))
    return both.groupBy("doc_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("way")), "+").alias("ways"))


def notice_search(spark: SparkSession, sf: str) -> DataFrame:
    """Of the 500 newest texts (largest ids) without table rows, 0.12 + 0.88 of the share of terms hit; the best four."""
    newest = table(spark, sf, "documents").orderBy(F.desc("doc_id")).limit(500)
    scored = newest.where(~F.contains("text", F.lit("|"))).select("doc_id", "n_chars", (texts.term_hits(F.col("text"), TERMS) / len(TERMS)).alias("hit"))
    return scored.where("hit > 0").select("doc_id", F.round(0.12 + 0.88 * F.col("hit"), 4).alias("score"), "n_chars").orderBy(F.desc("score"), F.desc("n_chars"), F.desc("doc_id")).limit(4)


def retrieval_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """For each language's hits: enough, too weak or without a required term, and how many."""
    scored = _lexical(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source", F.contains(F.lower("text"), F.lit("license")).alias("named")), "doc_id")
    per = scored.groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.bool_or("named").alias("named"))
    verdict = F.when(F.col("n") == 0, "none").when(F.col("best") < 0.3, "low score").when(~F.col("named"), "term missing").otherwise("enough")
    return per.select("lang", "source", "n", F.round("best", 4).alias("best"), verdict.alias("verdict"))


def hash_embed_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Signed feature hashing of the words in 384 dimensions, of unit length, as sparse rows.

    Texts are dealt by document once; words, dimensions and lengths are then summed where they are."""
    every = table(spark, sf, "documents")
    dealt = partitions.dealt(every.select("doc_id", "text"), every.count(), "doc_id", rows=TEXTS)  # the count is read from the files' ends
    words = dealt.select("doc_id", F.explode(texts.word_tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    d = words.select("doc_id", "n", texts.signed_feature(F.col("word")).alias("f"))
    summed = d.groupBy("doc_id", F.col("f.dimension").alias("dimension")).agg(F.sum(F.col("f.sign") * F.col("n")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc_id")).cast("double"))
    return summed.withColumn("norm", norm).where("doc_id IS NOT NULL AND v <> 0").select("doc_id", "dimension", F.round(F.col("v") / F.col("norm"), 6).alias("weight"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """An index and a later load of it: the last write of an id wins."""
    old = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = old.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return first_per_key(old.unionByName(new), ["vec_id"], [F.desc("version")]).select("vec_id", "label", "version")


def references(spark: SparkSession, sf: str) -> DataFrame:
    """What a result cites: the first filled of several titles, and 240 characters."""
    p = table(spark, sf, "pages")
    title = F.coalesce(texts.blank_to_null(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)), texts.blank_to_null(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), F.col("url"))
    return p.select("page_id", title.alias("title"), F.md5(F.substring("html", 1, 240)).alias("excerpt_md5"))


def vector_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For every fiftieth vector its five nearest of all."""
    index = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return plan.vector_hits(index, index.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 5)


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return documents, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def question_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions: lexical hits, reranked, the three best of each."""
    documents, questions = _questions(spark, sf)
    return plan.reranked(plan.merged(plan.lexical_hits(documents, questions, 20)), documents, questions, 3)


def question_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    documents, questions = _questions(spark, sf)
    return plan.judged(plan.lexical_hits(documents, questions, 20), questions, 0.6)


QUERIES = {f.__name__: f for f in (vector_batch_topk, question_batch, question_verdicts, vector_topk, vector_topk_filtered, lexical_search, metadata_search, rerank_boost, hybrid_merge, notice_search, retrieval_evaluate, hash_embed_sparse, vector_upsert, references)}

_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4)"
_NEAR = "(SELECT e.vec_id, e.label, " + _COSINE + " AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {} ORDER BY score DESC, e.vec_id LIMIT {})"
_HITS = lambda terms, text="text": "(" + " + ".join(f"contains(lower({text}), '{t.lower()}')::INT" for t in terms) + ")"
_LEX = f"(SELECT doc_id, round(least(1.0, 0.1::DOUBLE * {_HITS(TERMS)}), 4) AS score FROM documents)"
_TOP = f"(SELECT * FROM {_LEX} WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)"

_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_QUESTION = f"""WITH q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS w FROM benchmark), d AS (SELECT doc_id AS id, {_WORDS.format('text')} AS w FROM documents),
    s AS (SELECT query_id, id, round(least(1.0, len(list_intersect(q.w, d.w)) * 0.1::DOUBLE), 4) AS score, q.w AS qw, d.w AS dw FROM q JOIN d ON list_has_any(q.w, d.w)),
    h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20)"""

ORACLES = {
    "vector_batch_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) WHERE score > 0""",
    "question_batch": _QUESTION + """, r AS (SELECT query_id, id, round(least(1.0, score + 0.08::DOUBLE * len(list_intersect(list_filter(qw, lambda x: length(x) >= 4), dw))), 4) AS score FROM h)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""",
    "question_verdicts": _QUESTION + """, p AS (SELECT query_id, count(*) AS n, max(score) AS best FROM h GROUP BY 1)
        SELECT query_id, coalesce(n, 0) AS n, best, CASE WHEN n IS NULL THEN 'none' WHEN best < 0.6 THEN 'low score' ELSE 'enough' END AS verdict FROM q LEFT JOIN p USING (query_id)""",
    "vector_topk": f"SELECT vec_id, score FROM {_NEAR.format('true', 10)} WHERE score > 0",
    "vector_topk_filtered": f"SELECT vec_id, label, score FROM {_NEAR.format('e.label IS NULL OR e.label = 3', 20)} WHERE score > 0",
    "lexical_search": f"SELECT * FROM {_TOP}",
    "metadata_search": "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE coalesce(trim(lang), '') IN ('', 'de') AND coalesce(trim(source), '') IN ('', 'src0')",
    "rerank_boost": f"SELECT doc_id, round(least(1.0, score + 0.08::DOUBLE * {_HITS(['that', 'with', 'eau'])}), 4) AS score FROM {_TOP} JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 3",
    "hybrid_merge": f"""SELECT doc_id, max(score) AS score, string_agg(DISTINCT way, '+' ORDER BY way) AS ways FROM
        (SELECT vec_id AS doc_id, score, 'vector' AS way FROM {_NEAR.format('true', 40)} WHERE score > 0 UNION ALL SELECT doc_id, score, 'lexical' FROM {_TOP}) GROUP BY doc_id""",
    "notice_search": f"""SELECT doc_id, round(0.12 + 0.88 * h / {len(TERMS)}, 4)::DOUBLE AS score, n_chars FROM (SELECT *, {_HITS(TERMS)} AS h FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 500) WHERE NOT contains(text, '|'))
        WHERE h > 0 ORDER BY score DESC, n_chars DESC, doc_id DESC LIMIT 4""",
    "retrieval_evaluate": f"""SELECT lang, source, n, best, CASE WHEN best < 0.3 THEN 'low score' WHEN NOT named THEN 'term missing' ELSE 'enough' END AS verdict FROM
        (SELECT lang, source, count(*) AS n, max(score) AS best, bool_or(contains(lower(text), 'license')) AS named FROM documents JOIN {_LEX} USING (doc_id) GROUP BY ALL)""",
    "hash_embed_sparse": r"""WITH w AS (SELECT doc_id, sha256(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS h FROM documents),
        f AS (SELECT doc_id, (('0x' || left(h, 8))::BIGINT % 384)::INT AS dimension, sum(CASE WHEN ('0x' || substring(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL)
        SELECT doc_id, dimension, round(v / sqrt((sum(v * v) OVER (PARTITION BY doc_id))::DOUBLE), 6) AS weight FROM f QUALIFY v <> 0""",
    "vector_upsert": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings",
    "references": """SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ''), url) AS title, md5(left(html, 240)) AS excerpt_md5 FROM pages""",
}
