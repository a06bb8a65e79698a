"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, other columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, key string, ids string, words long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "x", 1) for i, t in rows], DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id"), (4, " \n\t  "), (5, "Don't we're I'll 12345 ÉÀ Σίσυφος ΟΔΟΣ <|endoftext|>x 日本語 👍🏽 é"),
    (6, "x" * 5000), (7, " " * 3000 + "end"), (8, "we've  they're\n\n  it's 1234567 ... !!! " * 120), (9, "the end. " * 700), (10, "the end. " * 700),
]
