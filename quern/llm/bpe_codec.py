"""Byte-level BPE encoding and decoding of whole texts.

Short texts are encoded in one piece. A long text is cut into chunks that overlap; every chunk is
pre-tokenised on its own, in parallel. The pre-token pattern never looks back, so from any position
that two neighbouring chunks both have as a pre-token boundary they agree on all later ones: the
first such position in their overlap is where the text is cut. Where an overlap holds no common
boundary (one pre-token fills it), the neighbours are joined into one piece. The pieces are then
encoded apart and their ids put together in order. A piece that is still long (LONG_CHARS), as one pre-token
of very many characters makes it, is encoded pre-token by pre-token: the library's own pattern engine ends the
process on long runs of white space.

Defined results: a null text is empty and gives no ids; repeated rows each give a row; equal long
texts are encoded once; columns besides the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import prepare, texts

#: Longest text, in characters, that is encoded in one piece, and how far chunks reach into the next.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Texts of more characters are not handed whole to the library's pattern engine.
LONG_CHARS = 100_000
#: More characters than the pattern's fixed alternatives and its look-ahead need.
MARGIN = 8

# The pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = PATTERN):
    """The encoder of a rank file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pre_tokens(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str = PATTERN, last: bool = True) -> list[int]:
    """Where pre-tokens start. Unless the text is the last of its document, starts within MARGIN of
    its end are left out: the pattern might have matched otherwise, had it seen what follows."""
    starts = [m.start() for m in _pre_tokens(pattern).finditer(text)]
    return starts if last else [s for s in starts if s <= len(text) - MARGIN]


def ids_of(encoder, text: str, pattern: str = PATTERN) -> list[int]:
    """The ids of a text, as the library gives them for each match of the pattern."""
    if len(text) <= LONG_CHARS:
        return encoder.encode_ordinary(text)
    return [i for m in _pre_tokens(pattern).finditer(text) for i in encoder._encode_single_piece(m.group())]


def _chunk_rows(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                starts = range(0, len(text), chunk)
                for low in range(0, len(starts), 64):
                    some = starts[low : low + 64]
                    parts = [text[s : s + chunk + overlap] for s in some]
                    final = [s + chunk >= len(text) for s in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some)), pa.array([s // chunk for s in some], pa.int64()), pa.array(list(some), pa.int64()), pa.array(final), pa.array(parts, pa.string())],
                        names=["key", "k", "start", "final", "part"],
                    )

    return run


def _edges(pattern: str, overlap: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, final, part in zip(batch["start"].to_pylist(), batch["final"].to_pylist(), batch["part"].to_pylist()):
                found = boundaries(part, pattern, final)
                heads.append([start + b for b in found if b < overlap])
                tails.append([start + b for b in found if b >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["k"], batch["start"], pa.array(heads, kind), pa.array(tails, kind)], names=["key", "k", "start", "head", "tail"])

    return run


def _encode(path: str, pattern: str, keep: tuple[str, ...], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern)
        for batch in batches:
            ids = [ids_of(encoder, t, pattern) for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return run


def _decode(path: str, pattern: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern)
        for batch in batches:
            raw = [encoder.decode_bytes(i) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), batch["ids"], pa.array(raw, pa.binary())], names=[*keep, "ids", "decoded"])

    return run


def pieces(long_texts: DataFrame, pattern: str = PATTERN, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, piece, text) of distinct (key, text): cut where neighbouring chunks resynchronise."""
    chunks = long_texts.mapInArrow(_chunk_rows(chunk, overlap), "key string, k long, start long, final boolean, part string")
    chunks = chunks.repartition("key", "k")
    edges = chunks.mapInArrow(_edges(pattern, overlap, chunk), "key string, k long, start long, head array<long>, tail array<long>")
    by_key = W.partitionBy("key").orderBy("k")
    cuts = edges.select("key", "k", "start", F.array_min(F.array_intersect("head", F.lag("tail").over(by_key))).alias("cut"))
    cuts = cuts.select(
        "key", "k", "cut",
        F.coalesce("cut", "start").alias("low"),
        F.lead(F.coalesce("cut", "start")).over(by_key).alias("high"),
        F.sum(F.col("cut").isNotNull().cast("long")).over(by_key).alias("piece"),
    )
    own = chunks.join(cuts.select("key", "k", "low", "high", "piece"), ["key", "k"])
    size = F.coalesce(F.col("high"), F.col("low") + F.lit(chunk + overlap)) - F.col("low")
    segment = F.substring("part", (F.col("low") - F.col("start") + 1).cast("int"), size.cast("int"))
    grouped = own.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("k", segment.alias("segment")))).alias("parts"))
    return grouped.select("key", "piece", F.array_join(F.col("parts.segment"), "").alias("text"))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", pattern: str = PATTERN, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    prepare(docs.sparkSession)
    base = texts(docs, id_column, text=text)
    kind = docs.schema[id_column].dataType.simpleString()
    short = base.where(F.length("text") <= chunk).mapInArrow(_encode(path, pattern, (id_column,), "text"), f"`{id_column}` {kind}, ids array<int>")
    long = base.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    encoded = pieces(long.select("key", "text").dropDuplicates(["key"]), pattern, chunk, overlap).mapInArrow(_encode(path, pattern, ("key", "piece"), "text"), "key string, piece long, ids array<int>")
    whole = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts")).select("key", F.flatten("parts.ids").alias("ids"))
    return short.unionByName(long.select(id_column, "key").join(whole, "key").select(id_column, "ids"))


def decode(encoded: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """``encoded`` (columns besides ids are kept) with the raw bytes of its ids, as ``decoded``."""
    prepare(encoded.sparkSession)
    keep = tuple(c for c in encoded.columns if c not in ("ids", "decoded"))
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids").mapInArrow(_decode(path, pattern, keep), f"{schema}, ids array<int>, decoded binary")
