"""Text expressions: tokens, normal forms, fingerprints, masks, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of all languages; \w alone is ASCII in Spark.
WORD = r"[\p{L}\p{N}_]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b01[0-9][- ]?[0-9]{3,4}[- ]?[0-9]{4}\b"
LONG_NUMBER = r"\b[0-9]{7,}\b"
SPACE = r"[ \t\n\x0B\f\r]+"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normal_text(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def fingerprint(text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the normal text's SHA-256; blank texts have an empty one."""
    normal = normal_text(F.coalesce(text, F.lit("")))
    return F.when(normal == "", "").otherwise(F.substring(F.sha2(normal, 256), 1, digits))


def mask_personal(text: Column) -> Column:
    masked = F.regexp_replace(text, EMAIL, "[EMAIL]")
    masked = F.regexp_replace(masked, PHONE, "[PHONE]")
    return F.regexp_replace(masked, LONG_NUMBER, "[ID]")


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-case text contains."""
    low = F.lower(text)
    return sum((low.contains(t.lower()).cast("int") for t in terms[1:]), low.contains(terms[0].lower()).cast("int"))


def ascii_ratio(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, ended at the last full stop within them if there is one."""
    head = F.substring(text, 1, most)
    tail = F.locate(".", F.reverse(head))
    return F.when(F.length(text) <= most, text).when(tail > 0, F.substring(head, F.lit(1), F.length(head) - tail + 1)).otherwise(head)


def paragraph_chunks(text: Column, size: int = 800, overlap: int = 120, separator: str = r"\n\s*\n", joint: str = "\n\n", whole_paragraph: bool = False) -> Column:
    """Chunks of whole paragraphs, which blank lines part: one closes when the next paragraph would take its
    paragraphs' length over ``size``, and the next starts with the last ``overlap`` characters of it, or with its last
    paragraph. A text without paragraphs is one; a null text has no chunks.

    The order-dependent fold runs over one row's array; what joins paragraphs does not count towards the size."""
    found = F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    parts = F.when(F.size(found) > 0, found).otherwise(F.array(text))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used"))

    def step(state: Column, part: Column) -> Column:
        full = (F.size(state["open"]) > 0) & (state["used"] + F.length(part) > size)
        closed = F.array_join(state["open"], joint)
        if whole_paragraph:
            tail = F.element_at(state["open"], -1)
        else:
            tail = F.when(F.length(closed) > overlap, F.substring(closed, F.lit(-overlap), F.lit(overlap))).otherwise(closed)
        return F.struct(
            F.when(full, F.array_append(state["done"], closed)).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(tail, part)).otherwise(F.array_append(state["open"], part)).alias("open"),
            F.when(full, F.length(tail) + F.length(part)).otherwise(state["used"] + F.length(part)).alias("used"),
        )

    chunks = F.aggregate(parts, start, step, lambda s: F.array_append(s["done"], F.array_join(s["open"], joint)))
    return F.when(text.isNotNull(), chunks).otherwise(F.array().cast("array<string>"))


def signed_feature(word: Column, dimensions: int = 384) -> Column:
    """A word's dimension and sign, from its SHA-256."""
    hashed = F.sha2(word, 256)
    return F.struct(
        (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % dimensions).cast("int").alias("dimension"),
        F.when(F.conv(F.substring(hashed, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"),
    )


def without_repeats(text: Column, memory: int = 6) -> Column:
    """A text without the sentences that repeat, as written but for white space, one of the last ``memory`` kept
    ones. Sentences end within a paragraph; line breaks stay, of three and more two."""
    ends = r"(?<=[.!?。！？요다까죠])\s+"
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.split(text, r"(?<=\n)(?=[^\n])|(?<=[^\n])(?=\n)")
    sentences = lambda part: F.filter(F.transform(F.split(part, ends), strip), lambda s: s != "")
    tokens = F.flatten(F.transform(parts, lambda part: F.when(part.startswith("\n"), F.array(part)).otherwise(sentences(part))))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("out"), none.alias("recent"), F.lit(False).alias("inside"))

    def step(state: Column, token: Column) -> Column:
        plain = F.regexp_replace(token, r"\s+", " ")
        seen = F.array_contains(state["recent"], plain)
        longer = F.array_append(state["recent"], plain)
        kept = F.when(F.size(longer) > memory, F.slice(longer, -memory, memory)).otherwise(longer)
        sentence = F.struct(
            F.concat(state["out"], F.when(state["inside"], " ").otherwise(""), token).alias("out"),
            kept.alias("recent"),
            F.lit(True).alias("inside"),
        )
        line = F.struct(F.concat(state["out"], token).alias("out"), state["recent"].alias("recent"), F.lit(False).alias("inside"))
        return F.when(token.startswith("\n"), line).when(seen, state).otherwise(sentence)

    return F.aggregate(tokens, start, step, lambda s: strip(F.regexp_replace(s["out"], r"\n{3,}", "\n\n")))


def fitted_count(lengths: Column, fixed: int, budget: int) -> Column:
    """How many of the chunks (token counts, best first) fit a budget beside its fixed part: the last ones go first,
    and one chunk stays if there is any."""
    start = F.struct(F.lit(0).alias("n"), F.lit(fixed).alias("used"), F.lit(True).alias("open"))

    def step(state: Column, length: Column) -> Column:
        fits = state["open"] & (state["used"] + length <= budget)
        return F.struct((state["n"] + fits.cast("int")).alias("n"), (state["used"] + length).alias("used"), fits.alias("open"))

    return F.least(F.size(lengths), F.greatest(F.lit(1), F.aggregate(lengths, start, step, lambda s: s["n"])))
