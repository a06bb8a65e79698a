import hashlib

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quern.llm import piece_codec
from tests.llm.data import AWKWARD, docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "a", " a", "a ", "  two  spaces  ", "tab\tand\nlines\r\n\n x", "▁ mark ▁▁ marks", "é É ½ ﬁ ① Ａ ｶﾞ ㍿ ¨ á  　 x​q", "日本語 のテキスト。", "👍🏽 \U0001F9D1‍\U0001F680 \x00 \x01 \x7f", "<s></s><unk><0x0A>",
    "don't we're 12345 3.14", "x" * 300, " " * 100 + "end" + " " * 50, "ΟΔΟΣ Σίσυφος ǅ ŉ", "\u0001start", "​ ​", "KK åÅ", "ſt st ﬆ ﷺ x ﷺ",
]


library = piece_codec.library


def changed(tmp_path, name, **spec):
    """The public model with another normalisation, byte fallback or kinds of pieces."""
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    if (rule := spec.pop("rule", None)) is not None:
        own = sentencepiece_model_pb2.NormalizerSpec.FromString(rule)
        model.normalizer_spec.precompiled_charsmap = own.precompiled_charsmap
    model.trainer_spec.byte_fallback = spec.pop("fallback", True)
    for piece in spec.pop("fixed", ()):
        model.pieces.add(piece=piece, score=0, type=4)
    for piece in spec.pop("unused", ()):
        next(p for p in model.pieces if p.piece == piece).type = 5
    for key, value in spec.items():
        setattr(model.trainer_spec if key == "treat_whitespace_as_suffix" else model.normalizer_spec, key, value)
    if not model.trainer_spec.byte_fallback:
        for p in model.pieces:
            if p.type == 6:
                p.type = 1
    path = tmp_path / f"{name}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def rules(name):
    """The compiled character map of one of the library's own normalisations."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=name)
    model = sentencepiece_model_pb2.ModelProto.FromString(made.serialized_model_proto())
    return model.normalizer_spec.SerializeToString()


def spans_of(path, text):
    found = library(path).encode(text, return_type="offset_mapping", return_bytes=True)
    return found["ids"], [tuple(o) for o in found["offsets"]]


VARIANTS = {
    "as_is": {},
    "nfkc": {"rule": "nmt_nfkc", "remove_extra_whitespaces": True},
    "nfkc_all_spaces": {"rule": "nmt_nfkc", "remove_extra_whitespaces": False},
    "folded": {"rule": "nmt_nfkc_cf", "remove_extra_whitespaces": True},
    "no_prefix": {"add_dummy_prefix": False},
    "suffix": {"treat_whitespace_as_suffix": True, "remove_extra_whitespaces": True},
    "fixed": {"fixed": ["two  sp", "日本語 の", "<0x", "mark▁▁▁", "and\nli"], "unused": ["▁the", "st"]},
    "no_bytes": {"fallback": False},
}


@pytest.mark.parametrize("name", VARIANTS)
def test_ids_and_spans_are_those_of_the_library(tmp_path, name):
    spec = dict(VARIANTS[name])
    if "rule" in spec:
        spec["rule"] = rules(spec["rule"])
    path = changed(tmp_path, name, **spec)
    coder = piece_codec.PieceCoder(path)
    for text in [*TEXTS, " ".join(TEXTS), "the rest of this best text " * 5]:
        ids, low, high, counts = coder.encode([text])
        assert (ids.tolist(), list(zip(low.tolist(), high.tolist()))) == spans_of(path, text), (name, text)
        assert counts.tolist() == [len(ids)]
    # several texts at once, words known and not
    ids, low, high, counts = coder.encode(TEXTS)
    assert ids.tolist() == [i for t in TEXTS for i in spans_of(path, t)[0]] and len(counts) == len(TEXTS)


def test_map_rules_hold_what_the_library_replaces():
    model = sentencepiece_model_pb2.NormalizerSpec.FromString(rules("nmt_nfkc"))
    found = piece_codec.map_rules(model.precompiled_charsmap)
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    assert len(found) > 5000 and piece_codec.map_rules(b"") == {}
    for key in sorted(found)[::37]:
        assert lib.normalize("x" + key + "y") == "x" + found[key] + "y"


def test_rows_of_the_awkward_table(spark):
    got = piece_codec.decode(piece_codec.encode(docs(spark, AWKWARD), PATH, end=True), PATH).collect()
    lib = library(PATH)
    want = [(i, ids := lib.encode(t or "", add_eos=True), lib.decode(ids)) for i, t in AWKWARD]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(want, key=str)
    texts = {(i, t or "") for i, t in AWKWARD}
    for r in got:
        own = next(t.encode() for i, t in texts if i == r.doc_id)
        assert r.begins[-1] == r.ends[-1] == len(own) and b"".join(own[a:b] for a, b in zip(r.begins, r.ends)) == own


def test_no_rows(spark):
    assert piece_codec.decode(piece_codec.encode(docs(spark, []), PATH), PATH).collect() == []


def test_query_digests_are_those_of_whole_texts(spark, sf):
    from quern.llm.queries import op13_sentencepiece

    lib = library(PATH)
    got = {r.doc_id: r for r in op13_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = lib.encode(row.text or "", add_eos=True)
        assert (got[row.doc_id].n_tokens, got[row.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_very_long_texts(spark):
    rows = [(1, "a" * 1_000_000), (2, " " * 1_000_000), (3, "line of words\n" * 70_000), (4, "語" * 300_000), (5, "one two " * 130_000)]
    lib = library(PATH)
    got = {r.doc_id: r for r in piece_codec.encode(docs(spark, rows), PATH, end=True).collect()}
    for i, text in rows:
        assert got[i].ids == lib.encode(text, add_eos=True) and got[i].ends[-1] == len(text.encode())


def test_few_words_are_kept(monkeypatch):
    monkeypatch.setattr(piece_codec, "KEEP_WORDS", 3)
    monkeypatch.setattr(piece_codec, "WORD_CHARS", 5)
    coder, lib = piece_codec.PieceCoder(PATH), library(PATH)
    for _ in range(2):
        for text in TEXTS:
            assert coder.encode([text, text])[0].tolist() == lib.encode(text) * 2
