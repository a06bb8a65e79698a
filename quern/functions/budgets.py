"""Fitting the parts of a prompt into a budget of estimated tokens, as one fold over lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as a token, and those that a chunk is not cut below.
CHARS_A_TOKEN, LEAST_CHUNK = 4, 300


def fitted_parts(fixed: Column, chunks: Column, shots: Column, memory: Column, style: Column, budget: int) -> Column:
    """struct<chunks array<int>, shots int, memory int, style int, tokens int>: how many characters stay of each chunk, of the
    memory and of the style, how many examples stay, and the estimate of it all.

    As long as the estimate is over the budget, one thing goes, of the first of these that there is: half of the memory;
    the last example, but not the only one; half of the longest chunk (of equally long ones the first), down to
    LEAST_CHUNK, or the last chunk if none is longer; half of the style. Parts are joined by line breaks, which count.
    Arguments are lengths: of the fixed text, arrays for chunks and examples, of memory and style."""
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    joined = lambda values: total(values) + F.greatest(F.size(values) - 1, F.lit(0))
    halvings = lambda length: F.ceil(F.log2(F.greatest(length, F.lit(1)) + 1)).cast("int") + 1
    whole = F.coalesce(chunks, F.array().cast("array<int>"))
    examples = F.coalesce(shots, F.array().cast("array<int>"))

    def tokens(s: Column) -> Column:
        chars = fixed + joined(s["chunks"]) + joined(F.slice(examples, F.lit(1), s["shots"])) + s["memory"] + s["style"] + 4
        return F.greatest(F.lit(1), F.floor(chars / CHARS_A_TOKEN).cast("int"))

    def state(chunks: Column, shots: Column, memory: Column, style: Column, tokens_: Column | None = None) -> Column:
        parts = [chunks.alias("chunks"), shots.cast("int").alias("shots"), memory.cast("int").alias("memory"), style.cast("int").alias("style")]
        return F.struct(*parts, *([] if tokens_ is None else [tokens_.alias("tokens")]))

    def step(s: Column, _: Column) -> Column:
        longest = F.array_max(s["chunks"])
        place = F.array_position(s["chunks"], longest) - 1
        cut = F.transform(s["chunks"], lambda c, i: F.when(i == place, F.greatest(F.lit(LEAST_CHUNK), F.floor(c / 2).cast("int"))).otherwise(c))
        fewer = F.when(longest > LEAST_CHUNK, cut).otherwise(F.slice(s["chunks"], F.lit(1), F.size(s["chunks"]) - 1))
        return (
            F.when(tokens(s) <= budget, s)
            .when(s["memory"] > 0, state(s["chunks"], s["shots"], F.floor(s["memory"] / 2), s["style"]))
            .when(s["shots"] > 1, state(s["chunks"], s["shots"] - 1, s["memory"], s["style"]))
            .when(F.size(s["chunks"]) > 0, state(fewer, s["shots"], s["memory"], s["style"]))
            .when(s["style"] > 0, state(s["chunks"], s["shots"], s["memory"], F.floor(s["style"] / 2)))
            .otherwise(s)
        )

    most = halvings(memory) + halvings(style) + F.size(examples) + total(F.transform(whole, lambda c: halvings(c) + 1)) + 1
    start = state(whole, F.size(examples), memory, style)
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: state(s["chunks"], s["shots"], s["memory"], s["style"], tokens(s)))


def rewritten(text: Column, row: Column, copy: Column, openings: tuple[str, ...], closings: tuple[str, ...], seed: int = 0) -> Column:
    """A row's text as its copy number ``copy`` has it: the first as it is, each later one between an opening and a closing
    of the given ones. Which one comes first is set by row and seed; the copies of one row differ until all pairs were used,
    and from then on also by a number in front."""
    pairs = len(openings) * len(closings)
    turn = F.pmod(row * 7 + seed + copy - 2, F.lit(pairs))
    pick = lambda words, place: F.array(*(F.lit(w) for w in words))[place.cast("int")]
    around = F.floor((copy - 2) / pairs)
    number = F.when(around > 0, F.concat(F.lit("("), (around + 1).cast("string"), F.lit(") "))).otherwise("")
    made = F.concat(number, pick(openings, turn % len(openings)), F.lit(" "), text, F.lit(" "), pick(closings, F.floor(turn / len(openings))))
    return F.when(copy <= 1, text).otherwise(made)
