"""SentencePiece BPE encoding with offsets into the original bytes, and decoding.

A text is normalised first: from each position the longest prefix that the model's compiled character map knows is
replaced, other characters stay. Every replacement notes how many bytes it read and wrote, so that each byte of the
normalised text has the place that it comes from in the original. White space becomes the model's space mark, and a
mark is put in front; both are noted alike. Pieces are then formed in the normalised text and projected back: each
has the original bytes from the place of its first byte to that of the byte after it.

The pieces themselves are found by the library, with its own normalisation switched off. No merge crosses a place that
no piece of the vocabulary crosses: where that holds for the starts of words, the pieces of a word are found once and kept
by each worker (KEEP_WORDS), and only words that are not known are handed on.

Defined results: a null or empty text has no pieces, but the end id where one is asked for; characters
without a piece become their bytes' pieces, the last of which has their span and the others empty ones,
or one unknown piece a run if the model has no bytes; the end id's span is empty, at the end;
repeated rows each give a row; columns besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import prepare, texts

#: Words whose pieces one Python worker keeps, about, and characters a word that these may have.
KEEP_WORDS, WORD_CHARS = 500_000, 100
#: Bytes of text that are encoded together; a longer text is encoded on its own.
TEXT_BYTES = 2 << 20
#: Ids that are handed to the library's decoder at once; a longer text's are decoded on their own.
DECODE_IDS = 200_000

# The space mark, and the kinds of pieces of the model format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def map_rules(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: a trie in a double array, then the texts that its
    values point to, each ended by a zero byte."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    labels, numbers = np.where(units & 0x80000000, 0, units & 0xFF), np.arange(1, 256)
    written = blob[4 + size :]
    rules: dict[str, str] = {}

    def children_at(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    todo = [(children_at(int(units[0])), b"")]
    while todo:
        place, key = todo.pop()
        near = place ^ numbers
        near = near[near < len(units)]
        for at in near[labels[near] == place ^ near].tolist():
            byte, unit = place ^ at, int(units[at])
            below = at ^ children_at(unit)
            if unit & 0x100:
                start = int(units[below]) & 0x7FFFFFFF
                rules[(key + bytes([byte])).decode(errors="surrogateescape")] = written[start : written.index(b"\0", start)].decode()
            todo.append((below, key + bytes([byte])))
    return rules


def utf8_sizes(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


class Normaliser:
    """Longest-prefix replacement by a character map, and the handling of white space, with alignment."""

    def __init__(self, rules: dict[str, str], keep: list[str], dummy_prefix: bool, fewer_spaces: bool, mark: bool, suffix: bool) -> None:
        import regex

        self.rules = rules | {k: k for k in keep}
        self.dummy_prefix, self.fewer_spaces, self.suffix = dummy_prefix, fewer_spaces, suffix
        self.space = MARK if mark else " "
        self.lengths: dict[str, list[int]] = {}
        for key in self.rules:
            self.lengths.setdefault(key[0], []).append(len(key))
        self.lengths = {c: sorted(set(n), reverse=True) for c, n in self.lengths.items()}
        self.first = regex.compile("[" + "".join(map(regex.escape, self.lengths)) + "]") if self.lengths else None

    def longest(self, text: str, at: int) -> int:
        """Where the longest prefix of ``text`` from ``at`` on that a rule knows ends, or ``at``."""
        for n in self.lengths.get(text[at], ()):
            if text[at : at + n] in self.rules:
                return at + n
        return at

    def replaced(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """(characters, where each comes from in the original's bytes, whether it leads its replacement): all
        characters that one replacement wrote come from the place where it read."""
        sizes = utf8_sizes(text)
        place = np.concatenate([[0], np.cumsum(sizes)])
        if self.first is None:
            return text, place, np.ones(len(text), bool)
        out, start, lead, low = [], [], [], 0
        for m in self.first.finditer(text):
            at = m.start()
            if at < low or (end := self.longest(text, at)) == at:
                continue
            written = self.rules[text[at:end]]
            out += [text[low:at], written]
            start += [place[low:at], np.full(len(written), place[at])]
            spaces = len(written) - len(written.lstrip(" "))
            lead += [np.ones(at - low, bool), np.arange(len(written)) < max(spaces, 1)]
            low = end
        start.append(place[low:])
        return "".join([*out, text[low:]]), np.concatenate(start), np.concatenate([*lead, np.ones(len(text) - low, bool)])

    def skipped(self, text: str) -> int:
        """Characters at the front that are read as single spaces."""
        at = 0
        while at < len(text):
            end = self.longest(text, at)
            if (self.rules[text[at:end]] if end > at else text[at]) != " ":
                break
            at = max(end, at + 1)
        return at

    def normal(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, for each of its characters and its end the place in the original's UTF-8 bytes)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.first is None and not self.fewer_spaces:
            place = np.arange(len(text) + 1) if text.isascii() else np.concatenate([[0], np.cumsum(utf8_sizes(text))])
            text = text.replace(" ", self.space)
            first = 0
        else:
            skip = self.skipped(text) if self.fewer_spaces else 0
            if skip == len(text):
                return "", np.array([len(text.encode())])
            first = len(text[:skip].encode())
            text, place, lead = self.replaced(text[skip:])
            place = place + first
            if self.fewer_spaces:
                blank = np.frombuffer(text.encode("utf-32-le"), "<u4") == 32
                # a space goes if its replacement starts with it and what was written before ends in one
                before = np.concatenate([[True], blank[:-1]])
                run = np.flatnonzero(~(blank & lead) | ~before)
                gone = np.ones(len(blank), bool)
                gone[run] = False
                keep = np.flatnonzero(~gone)
                text, place = "".join(map(text.__getitem__, keep.tolist())), np.append(place[:-1][keep], place[-1])
            text = text.replace(" ", self.space)
        if self.dummy_prefix and not self.suffix:
            text, place = self.space + text, np.concatenate([[first], place])
        if self.fewer_spaces:
            short = len(text.rstrip(self.space))
            text, place = text[:short], place[: short + 1]
        if self.dummy_prefix and self.suffix:
            text, place = text + self.space, np.append(place, place[-1])
        return text, place


def numbered() -> defaultdict[str, int]:
    """A dictionary that gives each key the next number when it is asked for the first time. It refers to itself:
    cleared, it leaves nothing behind."""
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    return found


class PieceCoder:
    """The pieces of one model file."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            blob = file.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(blob)
        self.end = model.trainer_spec.eos_id
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.fallback = model.trainer_spec.byte_fallback
        #: Bytes of normalised text that each piece reads; a byte's piece reads that byte.
        self.reads = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        spec = model.normalizer_spec
        fixed = [p.piece for p in model.pieces if p.type == USER_DEFINED]
        self.normaliser = Normaliser(map_rules(spec.precompiled_charsmap), fixed, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix)
        # the same model without normalisation: what comes in is normal already
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        model.trainer_spec.treat_whitespace_as_suffix = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        merges = model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        crossing = any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED))
        # a run of unknown characters may go on into the next word unless it becomes bytes
        self.words = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if merges and self.fallback and not crossing and spec.escape_whitespaces else None
        self.known = numbered()
        self.forget()

    def unknown_reads(self, normal: str) -> np.ndarray:
        """Bytes that each piece reads of a text with pieces for whole unknown runs."""
        pieces = self.segmenter.encode(normal, return_type="proto").pieces
        return np.array([len(p.surface.encode()) for p in pieces], np.int64)

    def words_of(self, normal: str) -> list[str]:
        """The words of a normalised text, without the mark that each starts with; one that starts with no mark or
        with several is given as it is, after a space, which no normalised text of such a model holds."""
        if not normal:
            return []
        if self.words is None:
            return [" " + normal]
        if MARK + MARK in normal or not normal.startswith(MARK):
            return [w[1:] if w.startswith(MARK) and not w.startswith(MARK + MARK) else " " + w for w in self.words.findall(normal)]
        return normal[1:].split(MARK)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other, how many each word has)."""
        if len(self.known) > KEEP_WORDS:
            self.forget()
        try:
            own = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            new = list(islice(self.known, self.held, None))
            if new:
                self.learn(self.segmenter.encode([w[1:] if w[:1] == " " else MARK + w for w in new], num_threads=1))
        except BaseException:
            self.forget()
            raise
        starts = self.edges[own]
        sizes = self.edges[own + 1] - starts
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(len(words) and ends[-1])]
        if sum(map(len, new)) > KEEP_WORDS * WORD_CHARS:
            self.forget()
        return ids, sizes

    def learn(self, found: list[list[int]]) -> None:
        """Put the ids of the next words behind those that are held; room is doubled when it is used up."""
        ends = self.edges[self.held] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        while len(self.edges) <= self.held + len(found):
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.edges[self.held] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32)
        self.edges[self.held + 1 : self.held + 1 + len(found)] = ends
        self.held += len(found)

    def forget(self) -> None:
        self.known.clear()
        self.held, self.ids, self.edges = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, byte after the last, pieces of each text): the texts' pieces one after the other, with
        the places in the original text that each stands for."""
        normal = [self.normaliser.normal(t) for t in texts]
        words = [self.words_of(n) for n, _ in normal]
        ids, sizes = self.pieces(list(chain.from_iterable(words)))
        last = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, words)])]
        reads = self.reads[ids]
        low, high = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for (written, place), a, b in zip(normal, last.tolist(), last[1:].tolist()):
            own = reads[a:b]
            if not self.fallback and np.any(ids[a:b] == self.unknown):
                own = self.unknown_reads(written)
            # each byte of the normal text comes from the place of its character
            source = place if written.isascii() else np.append(np.repeat(place[:-1], utf8_sizes(written)), place[-1])
            edges = np.cumsum(own)
            high[a:b] = source[edges]
            low[a:b] = source[edges - own]
        return ids, low, high, np.diff(last)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """A model's pieces; one for each Python worker."""
    return PieceCoder(path)


@lru_cache(maxsize=2)
def library(path: str):
    """The library's own processor of a model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def runs_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows with about ``most`` in all, by the rows' running sums."""
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last
        row = last


def _encode(path: str, id_column: str, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder_ = coder(path)
        for batch in batches:
            sizes = pc.cast(pc.binary_length(batch["text"]), pa.int64()).to_numpy(zero_copy_only=False)
            for row, last in runs_of(np.concatenate([[0], np.cumsum(sizes)]), TEXT_BYTES):
                ids, low, high, counts = coder_.encode(batch["text"].slice(row, last - row).to_pylist())
                if end:
                    at, size = np.cumsum(counts), sizes[row:last]
                    ids, low, high = np.insert(ids, at, coder_.end), np.insert(low, at, size), np.insert(high, at, size)
                    counts = counts + 1
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (ids, low, high)]
                yield pa.RecordBatch.from_arrays([batch[id_column].slice(row, last - row), *lists], names=[id_column, "ids", "begins", "ends"])

    return run


def _decode(path: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = library(path)
        for batch in batches:
            for row, last in runs_of(batch["ids"].offsets.to_numpy(), DECODE_IDS):
                some = batch.slice(row, last - row)
                out = decoder.decode([x or [] for x in some["ids"].to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), pa.array(out, pa.string())], names=[*keep, "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", end: bool = False) -> DataFrame:
    """(id, ids, begins, ends): the piece ids of every whole text, and for each id the bytes begins[i] to ends[i] of
    the original text in UTF-8 that it stands for. With ``end``, the model's end id is put last."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return texts(docs, id_column, text=text).mapInArrow(_encode(path, id_column, end), f"`{id_column}` {kind}, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (its columns are kept) with the text that the model's library makes of its ids, as ``decoded``."""
    prepare(encoded.sparkSession)
    keep = tuple(c for c in encoded.columns if c != "decoded")
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep).mapInArrow(_decode(path, keep), f"{schema}, decoded string")
