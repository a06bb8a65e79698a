"""Titles of planned events: keys under which spellings of one title are equal, and short titles to show.

All words are parameters (`TitleWords`); a key ignores marks before a title, its status in brackets, wrapping
phrases, punctuation, spaces and case. A null title counts as an empty one, and has an empty key."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.native_gaps import compatibility_form


@dataclass(frozen=True)
class TitleWords:
    """labels: bracketed before a title and of no meaning to a comparison; noise: the same for showing; statuses: in round brackets
    anywhere; wrappers: phrases of the tables that titles stand in; live: the two words of a broadcast's mark; practice and
    joined: how a practice with questions is told; subject: a course whose numbers and prefix are dropped."""

    # The surveyed words.
    labels: tuple[str, ...] = ("학습", "공지", "안내")
    noise: tuple[str, ...] = ("학습", "Live 방송", "LIVE 방송")
    statuses: tuple[str, ...] = ("예정", "수정", "변경", "안내", "공지")
    wrappers: tuple[str, ...] = ("트랙 시간표", "주차 시간표", "학습 주차", "커리큘럼")
    live: tuple[str, str] = ("Live", "방송")
    practice: str = "실습"
    joined: str = "및"
    subject: tuple[str, str] = ("JS", "Basic Syntax")


WORDS = TitleWords()
MOST = 80


def one_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def spaced(text: Column) -> Column:
    """Without outer white space, and a single space for each inner one; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def compact(text: Column) -> Column:
    """Capitals without spaces, stops, dashes, strokes, colons and brackets."""
    return F.upper(F.regexp_replace(text, r"[\s.:/_()\[\]-]+", ""))


def _live(words: TitleWords) -> str:
    first, second = map(re.escape, words.live)
    return rf"(?i)^\s*\[?\s*{first}\s*{second}\s*\]?\s*"


def title_key(title: Column, words: TitleWords = WORDS) -> Column:
    text = compatibility_form(spaced(title))
    dropped = (rf"^\s*\[{one_of(words.labels)}\]\s*", _live(words), rf"\s*\({one_of(words.statuses)}\)?", r"\s*\([^)]{1,2}$")
    for pattern in dropped:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, one_of(words.wrappers), " ")
    text = F.regexp_replace(text, r"(?i)\bQ(?:\s*&\s*|\s+AND\s+|N)A\b", "QNA")
    # without spaces, a practice with questions has three forms
    with_questions = F.lit(f"{words.practice}{words.joined}QNA".upper())
    practice, joined = (re.escape(w.upper()) for w in (words.practice, words.joined))
    return F.regexp_replace(compact(text), f"QNA{practice}QNA|{practice}(?:{joined})?QNA", with_questions)


def _shown_label(text: Column, words: TitleWords) -> Column:
    """Noise labels go; one of practice or questions becomes the words in front. The text is named once, so that passes do not
    double the expression."""
    bracketed = lambda labels: rf"^\s*\[\s*{one_of(labels)}\s*\]\s*"
    asked = (f"{words.practice} {words.joined} Q&A", f"{words.practice} Q&A", "Q&A")
    return F.regexp_replace(F.regexp_replace(text, bracketed(asked), asked[1] + " "), bracketed(words.noise), "")


def display_title(title: Column, words: TitleWords = WORDS, passes: int = 4) -> Column:
    """At most 80 characters without times, labels and broadcast marks before them; a title of nothing else stays as it is."""
    clock = r"[0-9]{1,2}\s*:\s*[0-9]{2}"
    times = rf"(?i)^\s*{clock}(?:\s*(?:~|-|to|부터)\s*{clock})?\s*"
    original = text = spaced(title)
    for _ in range(passes):
        text = F.regexp_replace(_shown_label(F.regexp_replace(text, times, ""), words), _live(words), "")
    prefix, subject = (r"\s+".join(map(re.escape, w.split())) for w in words.subject)
    text = F.regexp_replace(spaced(text), rf"(?i)\b{prefix}\s+{subject}\s*[0-9]*\b", words.subject[1])
    text = F.regexp_replace(text, rf"(?i)\b{subject}\s*[0-9]+\b", words.subject[1])
    text = F.replace(text, F.lit(f"{words.practice} {words.joined} Q&A"), F.lit(f"{words.practice} Q&A"))
    text = F.regexp_replace(spaced(text), r"^[ :\-|\[\]()~]+|[ :\-|\[\]()~]+$", "")
    return F.substring(F.when(text != "", text).otherwise(original), 1, MOST)
