import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import byte_words, resample
from tests.llm.data import AWKWARD, docs

LETTERS = [
    (1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "no id but twenty words " * 6), (4, " \n\t "), (5, "Don't É日本語x 12-34 ÀB"), (6, "x" * 300 + " " + "é" * 90 + " y"),
    (7, "the end. " * 40), (8, "the end. " * 40), (9, "One two Three " * 30), (10, "w" * 64 + " " + "w" * 65 + " " + "w" * 66), (11, "ends here"), (12, "starts here"), *((i, f"rain falls on the old town number {i} " * 5) for i in range(20, 60)),
]
TARGET = [(1, "the end of the old town"), (2, "rain falls"), (3, None), (4, "")]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        for f in features(text)[1]:
            s[bucket(f)] += 1
    for _, text in target:
        for f in features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): k for k, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return sorted([(*r, place.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_draw_is_that_of_brute_force(spark, percent):
    rows = LETTERS + [(i, t) for i, t in AWKWARD if i not in (3, None)]
    rows = [(None if i is None else i + 100 * (k >= len(LETTERS)), t) for k, (i, t) in enumerate(rows)]
    got = resample.resample(docs(spark, rows), docs(spark, TARGET), percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, TARGET, percent)


def test_repeated_rows_may_all_be_drawn(spark):
    rows = [(i % 7, "the old town of rain " * (i % 7 + 4)) for i in range(70)]
    got = [tuple(r) for r in resample.resample(docs(spark, rows), docs(spark, TARGET), percent=50).collect()]
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 36))
    assert [r[4] for r in sorted((r for r in got if r[5]), key=lambda r: r[5])] == sorted((r[4] for r in got), reverse=True)[:35]


def test_empty_tables(spark):
    assert resample.resample(docs(spark, []), docs(spark, TARGET)).collect() == []
    assert [r.weight for r in resample.resample(docs(spark, [(1, None)]), docs(spark, [])).collect()] == [0]


def test_long_words_and_texts(spark):
    rows = [(1, "a" * 1_500_000), (2, "ab " * 500_000), (3, "line\n" * 300_000 + "é" * 100_000)]
    got = resample.resample(docs(spark, rows), docs(spark, TARGET), percent=100)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, TARGET, 100)


def test_words_do_not_go_on_into_the_next_row():
    column = pa.array(["ab", "cd", "", "", "e f", "", "gh", " ", "i"])
    [(first, data, offsets)] = byte_words.blocks(column)
    starts, ends, row = byte_words.spans(data, offsets, resample.WORD_BYTES)
    assert [(r, bytes(data[a:b])) for a, b, r in zip(starts, ends, row)] == [(0, b"ab"), (1, b"cd"), (4, b"e"), (4, b"f"), (6, b"gh"), (8, b"i")]
    small = [(first, bytes(data), offsets.tolist()) for first, data, offsets in byte_words.blocks(column.slice(1), 3)]
    assert b"".join(d for _, d, _ in small) == b"cde fgh i" and [f for f, _, _ in small] == sorted({f for f, _, _ in small})
