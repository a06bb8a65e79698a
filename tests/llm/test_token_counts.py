import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import token_counts
from tests.llm.data import AWKWARD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_are_those_of_the_library(spark, library):
    got = token_counts.count_tokens(docs(spark, AWKWARD), PATH, budget=500).collect()
    want = [(i, len((t or "").encode()), count(library, t or "")) for i, t in AWKWARD]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    for row in got:
        text = dict(AWKWARD)[row.doc_id] or ""
        if row.n_tokens > 500:
            assert count(library, text[: row.budget_chars]) <= 500 < count(library, text[: row.budget_chars + 1])
        else:
            assert row.budget_chars is None


def test_every_prefix_has_the_count_of_the_library(spark, library):
    rows = [(5, AWKWARD[6][1]), (8, "we've they're it's 42 ...!? Straße naïve"), (9, "don'tre 'll'v 'r")]
    for row in token_counts.count_tokens(docs(spark, rows), PATH, prefixes=True).collect():
        text = dict(rows)[row.doc_id]
        assert row.prefix_tokens == [count(library, text[:i]) for i in range(len(text) + 1)]


def test_no_rows(spark):
    assert token_counts.count_tokens(docs(spark, []), PATH).collect() == []


def test_query_over_documents(spark, sf, library):
    from quern.llm.queries import op6_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for row in got:
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n := count(library, texts[row.doc_id]), len(texts[row.doc_id].encode()), n > 2048)
