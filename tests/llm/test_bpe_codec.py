import hashlib

import public_tokenizers
import pytest

from quern.llm import bpe_codec
from tests.llm.data import AWKWARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (257, 33), (64, 16)])
def test_ids_are_those_of_the_library_and_decode_gives_the_text_back(spark, chunk, overlap):
    got = bpe_codec.decode(bpe_codec.encode(docs(spark, AWKWARD), PATH, chunk=chunk, overlap=overlap), PATH).collect()
    encoder = bpe_codec.codec(PATH)
    want = [(i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t in AWKWARD]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    assert bpe_codec.decode(bpe_codec.encode(docs(spark, []), PATH), PATH).collect() == []


def test_query_digests_are_those_of_whole_texts(spark, sf):
    from quern.llm.queries import op8_byte_bpe

    encoder = bpe_codec.codec(PATH)
    got = {r.doc_id: r for r in op8_byte_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = encoder.encode_ordinary(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_very_long_runs_and_texts(spark):
    """Runs that end the library's pattern engine, and texts of many chunks, through the default parameters."""
    import regex

    words = " ".join(f"word{i} Überfluß, {i}!" for i in range(30_000))
    rows = [(1, " " * 2_000_000 + "x"), (2, "\n" * 2_000_000 + "x"), (3, "a" * 2_000_000), (4, "é" * 150_000 + " " * 150_000 + "!"), (5, words), (6, words + " " * 5_000 + "end"), (7, "1" * 2_000_000 + " ")]
    encoder, pattern = bpe_codec.codec(PATH), regex.compile(bpe_codec.PATTERN)
    got = {r.doc_id: r for r in bpe_codec.decode(bpe_codec.encode(docs(spark, rows), PATH), PATH).collect()}
    for i, text in rows:
        assert bytes(got[i].decoded) == text.encode()
        assert got[i].ids == [x for m in pattern.finditer(text) for x in encoder._encode_single_piece(m.group())]
    assert got[5].ids == encoder.encode_ordinary(words)
