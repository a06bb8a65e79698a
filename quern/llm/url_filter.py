"""URL filtering by host and path rules and by association rules mined from labelled pages.

Given rules decide first: the longest that fits. For the other urls, FP-growth mines combinations of
url tokens that go with the label; a combination becomes a rule if its support and confidence suffice, its
odds of a bad page are well over those of any page, and no part of it says as much. Pages are labelled by the caller, or else by the given rules: the urls that
these decide are the examples for the urls that they leave open. Tokens that are on the same labelled pages are
one token to the mining (the least of them stands for all), so that a template with many fixed tokens does not
give every combination of them, and only tokens of bad pages are mined. The rules form an inverted index by
their least frequent token: a url is compared only with the rules whose index token it has, and is blocked if
one of them fits.

DataFrame and pyspark.ml operations only. Defined results: a null url, or one without ``://``, has
empty host and path and no tokens, is fitted by no rule and allowed; repeated rows each give a row
and all count when mining; without labelled pages, or where all of them are bad or none is, no rules are mined and all is
allowed that no given rule blocks; columns besides the id and the url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """Thresholds: a rule's bad pages as a share of all labelled ones, share of its pages that are bad, its pages, and the
    odds that one of its pages is bad against the odds of any labelled page."""

    min_support: float = 0.002
    min_confidence: float = 0.6
    min_pages: int = 20
    min_odds_ratio: int = 3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def judge(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` with host, path, rule and rule_verdict (null where no rule fits)."""
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        hit = fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(hit, F.lit(r.name)).otherwise(rule), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, path segments without digits, depth, query keys, fragment, scheme."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.filter(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")), lambda x: x != "")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([A-Za-z_]+)="), F.lit(1))
    other = F.array(
        F.concat(F.lit("s:"), F.substring_index(url, "://", 1)),
        F.concat(F.lit("d:"), F.size(segments).cast("string")),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    found = F.concat(labels, F.transform(segments, lambda x: F.concat(F.lit("p:"), x)), F.transform(keys, lambda x: F.concat(F.lit("q:"), x)), F.filter(other, lambda x: x.isNotNull()))
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def telling(labelled: DataFrame) -> DataFrame:
    """(tokens, bad) with only tokens of bad pages, and of tokens on the same pages the least one."""
    groups = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    own = groups.select("tokens", "n", "n_bad", F.explode("tokens").alias("token"))
    # pages of equal tokens go together; two sums of independent hashes stand for a token's set of them
    pages = [F.sum(F.xxhash64("tokens", F.lit(seed)).cast("decimal(20,0)")).alias(f"pages_{seed}") for seed in (1, 2)]
    counted = own.groupBy("token").agg(*pages, F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")).where("n_bad > 0")
    kept = counted.groupBy("n", "pages_1", "pages_2").agg(F.min("token").alias("token"))
    found = own.join(kept.select("token"), "token").groupBy("tokens").agg(F.collect_list("token").alias("mined"))
    return labelled.join(found, "tokens", "left").select(F.coalesce("mined", F.array().cast("array<string>")).alias("tokens"), "bad")


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, index_token, confidence, support) from (tokens, bad)."""
    found = cut_lineage(telling(labelled))
    baskets = found.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    # stored, since it is read many times and each reading would mine again
    frequent = cut_lineage(FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(baskets).freqItemsets)
    bad = frequent.where(F.array_contains("items", BLOCK) & (F.size("items") > 1))
    bad = bad.select(F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), F.col("freq").alias("support"))
    plain = frequent.where(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    n_all, n_bad = found.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    # in whole numbers: support / (n - support) at or over the ratio times n_bad / (n_all - n_bad)
    telling_apart = F.col("support") * (n_all - n_bad) >= mining.min_odds_ratio * n_bad * (F.col("n") - F.col("support"))
    strong = bad.join(plain, "tokens").withColumn("confidence", F.col("support") / F.col("n")).withColumn("apart", telling_apart & F.lit(n_bad < n_all))
    # support falls with every token more, so the parts of a frequent combination are all here: carry the best
    # confidence of any part upwards, one token at a time
    strong = cut_lineage(strong.where(F.col("n") >= mining.min_pages).select("tokens", "support", "confidence", "apart"))
    longest = strong.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0]
    best = strong.where(F.size("tokens") == 1).select("tokens", "support", "confidence", "apart", F.lit(-1.0).alias("part"))
    levels = [best]
    for size in range(2, longest + 1):
        above = levels[-1].select(F.col("tokens").alias("fewer"), F.greatest("confidence", "part").alias("best"))
        own = strong.where(F.size("tokens") == size)
        fewer = own.select("tokens", F.explode("tokens").alias("token")).select("tokens", F.array_remove("tokens", F.col("token")).alias("fewer"))
        parts = fewer.join(above, "fewer").groupBy("tokens").agg(F.max("best").alias("part"))
        levels.append(cut_lineage(own.join(parts, "tokens", "left").select("tokens", "support", "confidence", "apart", F.coalesce("part", F.lit(-1.0)).alias("part"))))
    every = reduce(DataFrame.unionByName, levels)
    kept = every.where(F.col("apart") & (F.col("confidence") >= mining.min_confidence) & (F.col("part") < F.col("confidence"))).select("tokens", "support", "confidence")
    single = plain.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("n").alias("token_n"))
    least = kept.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("token_n", "token")).alias("index_token"))
    return kept.join(least, "tokens").select("tokens", "index_token", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule, confidence) of the most confident rule that fits (tokens)."""
    probe = urls.select("tokens", F.explode("tokens").alias("index_token"))
    hits = probe.join(rules.withColumnRenamed("tokens", "needed"), "index_token").where(F.size(F.array_except("needed", "tokens")) == 0)
    name = F.array_join("needed", " ")
    return hits.groupBy("tokens").agg(F.max_by(name, F.struct("confidence", "support", name.alias("name"))).alias("mined_rule"), F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, mining: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence). ``labels`` has (page_id, bad); without it, the
    urls that a given rule decides are labelled by its verdict."""
    judged = judge(pages.select("page_id", "url"), rules)
    keyed = judged.withColumn("tokens", F.array_sort(url_tokens(F.col("host"), F.col("path"), F.col("url"))))
    if labels is None:
        labelled = keyed.where(F.col("rule").isNotNull()).select("tokens", (F.col("rule_verdict") == "block").alias("bad"))
    else:
        labelled = keyed.join(labels.where(F.col("bad").isNotNull()).select("page_id", "bad"), "page_id").select("tokens", "bad")
    # equal token sets are compared with the index once
    found = match(keyed.where(F.col("rule").isNull()).select("tokens").distinct(), mine(labelled, mining))
    open_ones = keyed.where(F.col("rule").isNull()).join(found, "tokens", "left")
    decided = keyed.where(F.col("rule").isNotNull())
    out = open_ones.unionByName(decided, allowMissingColumns=True)
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule", "confidence",
    )
