"""Exact token counts of every prefix of a text, for a vocabulary of merges with word ends.

A pre-token's table holds, for each of its prefixes, the number of tokens that the prefix has as a
word of its own. It comes from dynamic programming: the encoding of a prefix ends in the one token
that is compatible with the last token of what stands before it, where two tokens are compatible if
the merges, run on both together, give them back. So a prefix has one token more than the prefix
that its last token leaves over, and nothing is encoded twice. A text's count at any position is
the sum of the words before it and one entry of a table; a whole text's is that at its end. Truncation and budget questions read those
tables (`count_at`, `longest_within`).

Positions are characters of the normalised text (NFC, lower case, white space left in place), which
for nearly all texts are those of the text itself. Special strings within a text count as one token,
as the library takes them by default.

Defined results: a null or empty text has no tokens; repeated rows each give a row; columns besides
the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import prepare, texts

#: Words, prefixes of words and compatibilities of token pairs that one Python worker keeps at most,
#: and the longest word, in symbols, whose prefixes it keeps.
KEEP_WORDS = 1_500_000
KEEP_PREFIXES = 1_500_000
KEEP_PAIRS = 1_000_000
LONG_WORD = 48

# The pre-token pattern of the vocabulary, its contractions, and the end of a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
CONTRACTIONS = ("'re", "'ve", "'ll")
END = "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Prefix tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocabulary = set(spec["model"]["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.made = {a + b: (r, a, b) for (a, b), r in reversed(self.rank.items())}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocabulary)
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.prefixes: dict[str, tuple[str, int]] = {"": ("", 0)}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.specials = tuple(specials)
        self.words = regex.compile(PATTERN)
        self.totals: dict[str, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges run on symbols, lowest rank first and leftmost among equals."""
        while len(symbols) > 1:
            ranked = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get(pair)) is not None]
            if not ranked:
                break
            at = min(ranked)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def whole(self, token: str) -> bool:
        """True if the merges, run on the token's symbols, give the token back."""
        body = token.removesuffix(END)
        symbols = list(body)
        if len(body) < len(token):
            symbols[-1] += END
        return self.merged(symbols) == [token]

    def compatible(self, left: str, right: str) -> bool:
        """True if the merges keep the tokens ``left`` and ``right`` apart and whole; left may be empty.

        The two symbols at the border change when a merge makes the token around one of them. Undone
        from the last of those merges to the first, each state (x, y) stood until a known rank; the
        pair would have been merged across the border if its own rank comes before that.
        """
        if (found := self.fits.get((left, right))) is not None:
            return found
        if len(self.fits) >= KEEP_PAIRS:
            self.fits.clear()
        if not left:
            found = self.whole(right)
        else:
            x, y, until, found = left, right, float("inf"), self.compatible("", right)
            while found:
                rank = self.rank.get((x, y))
                if rank is not None and rank < until:
                    found = False
                    break
                made_x, made_y = self.made.get(x), self.made.get(y)
                if made_x is None and made_y is None:
                    break
                if made_y is None or (made_x is not None and made_x[0] > made_y[0]):
                    until, x = made_x[0], made_x[2]
                else:
                    until, y = made_y[0] + 1, made_y[1]
        self.fits[left, right] = found
        return found

    def symbols(self, word: str) -> str:
        """The word's bytes, each as its letter in the vocabulary."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def last_start(self, mapped: str, i: int, states, end: str) -> int:
        """Where the last token of the prefix of i symbols starts; ``states`` gives the states before."""
        vocabulary, fits = self.vocabulary, self.fits
        for j in range(i - 1, max(-1, i - self.longest - 1), -1):
            token = mapped[j:i] + end
            if token in vocabulary:
                before = states(j)[0]
                ok = fits.get((before, token))
                if ok or (ok is None and self.compatible(before, token)):
                    return j
        raise ValueError(f"no encoding of {mapped!r}")

    def states(self, mapped: str) -> list[tuple[str, int]]:
        """For each prefix of the symbols, not ended as a word, its last token and token count."""
        found = [("", 0)]
        for i in range(1, len(mapped) + 1):
            j = self.last_start(mapped, i, found.__getitem__, "")
            found.append((mapped[j:i], found[j][1] + 1))
        return found

    def total(self, word: str) -> int:
        """Tokens of one pre-token. Words share the states of the prefixes that they share."""
        if len(self.totals) >= KEEP_WORDS:
            self.totals.clear()
        mapped = self.symbols(word)
        size = len(mapped)
        if size > LONG_WORD:
            found = self.states(mapped)
            total = found[self.last_start(mapped, size, found.__getitem__, END)][1] + 1
        else:
            prefixes, vocabulary, fits = self.prefixes, self.vocabulary, self.fits
            if len(prefixes) >= KEEP_PREFIXES:
                prefixes.clear()
                prefixes[""] = ("", 0)
            known = size - 1
            while mapped[:known] not in prefixes:
                known -= 1
            # the states that are missing, and last the end of the word
            for i in range(known + 1, size + 1):
                end = END if i == size else ""
                for j in range(i - 1, -1, -1):
                    if (token := mapped[j:i] + end) in vocabulary:
                        before, count = prefixes[mapped[:j]]
                        ok = fits.get((before, token))
                        if ok or (ok is None and self.compatible(before, token)):
                            break
                else:
                    raise ValueError(f"no encoding of {mapped!r}")
                if i < size:
                    prefixes[mapped[:i]] = (token, count + 1)
            total = count + 1
        self.totals[word] = total
        return total

    def table(self, word: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, … characters of one pre-token, each ended there."""
        if word in CONTRACTIONS:  # cut short, it is an apostrophe and a word
            return [self.total("'"), self.total("'") + self.total(word[1]), self.total(word)]
        mapped = self.symbols(word)
        found = self.states(mapped)
        ends = accumulate(len(c.encode()) for c in word) if len(mapped) > len(word) else range(1, len(word) + 1)
        return [found[self.last_start(mapped, i, found.__getitem__, END)][1] + 1 for i in ends]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text's stretches between special strings, and those strings."""
        if not self.special or not any(s in text for s in self.specials):
            return [(text, False)]
        return [(part, part in self.specials) for part in self.special.split(text) if part]

    def counted(self, words: list[str]) -> list[int]:
        counts = list(map(self.totals.get, words))
        if None in counts:
            counts = [self.total(w) if c is None else c for w, c in zip(words, counts)]
        return counts

    def count(self, text: str) -> int:
        """Tokens of the whole text: the count at the last prefix of each pre-token, summed."""
        return sum(1 if special else sum(self.counted(self.words.findall(self.normal(part)))) for part, special in self.parts(text))

    def count_within(self, text: str, budget: int) -> tuple[int, int | None]:
        """Tokens of the whole text, and if they are over the budget, longest_within."""
        parts = self.parts(text)
        if len(parts) != 1 or parts[0][1]:
            total = self.count(text)
            return total, self.longest_within(text, budget) if total > budget else None
        normal = self.normal(text)
        counts = self.counted(self.words.findall(normal))
        total = sum(counts)
        if total <= budget:
            return total, None
        before = end = 0
        for n, m in zip(counts, self.words.finditer(normal)):
            if before + n > budget:
                fitting = [i for i, c in enumerate(self.table(m[0]), 1) if before + c <= budget]
                return total, m.start() + fitting[-1] if fitting else end
            before, end = before + n, m.end()
        raise AssertionError("the counts exceed the budget somewhere")

    def spans(self, text: str) -> Iterator[tuple[int, str, int]]:
        """(position, pre-token, tokens before it) over the normalised text; a special string is one."""
        at = before = 0
        for part, special in self.parts(text):
            if special:
                yield at, part, before
                at, before = at + len(part), before + 1
                continue
            part = self.normal(part)
            for m in self.words.finditer(part):
                yield at + m.start(), m[0], before
                total = self.totals.get(m[0])
                before += self.total(m[0]) if total is None else total
            at += len(part)

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, … characters of the normalised text. A special
        string counts once it is whole; cut short, it is ordinary text and counted as such."""
        out = [0]
        for at, word, before in self.spans(text):
            out.extend([before] * (at + 1 - len(out)))
            if word in self.specials:
                out.extend(before + self.count(word[:i]) for i in range(1, len(word)))
                out.append(before + 1)
            else:
                out.extend(before + n for n in self.table(word))
        length = sum(len(p if s else self.normal(p)) for p, s in self.parts(text))
        out.extend([self.count(text)] * (length + 1 - len(out)))
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that ends after a whole or cut pre-token within the budget."""
        end = 0
        for at, word, before in self.spans(text):
            counts = [1] if word in self.specials else self.table(word)
            if before + counts[-1] <= budget:
                end = at + len(word)
                continue
            if word in self.specials:
                return end
            fitting = [i + 1 for i, n in enumerate(counts) if before + n <= budget]
            return at + fitting[-1] if fitting else end
        return end


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The vocabulary's tables; one for each Python worker."""
    return PrefixCounter(path)


def _count(path: str, id_column: str, budget: int, prefixes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(path)
        for batch in batches:
            whole = batch["text"].to_pylist()
            counts, cuts = zip(*(tables.count_within(t, budget) for t in whole)) if whole else ((), ())
            columns = [batch[id_column], pc.cast(pc.binary_length(batch["text"]), pa.int64()), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())]
            names = [id_column, "n_bytes", "n_tokens", "budget_chars"]
            if prefixes:
                columns.append(pa.array([tables.prefix_counts(t) for t in whole], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def count_tokens(docs: DataFrame, path: str, budget: int = 2048, id_column: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, budget_chars): budget_chars is the length of the longest prefix within
    the budget, null where the whole text is. With ``prefixes``, also every prefix's count."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, n_tokens long, budget_chars long" + ", prefix_tokens array<int>" * prefixes
    return texts(docs, id_column, text=text).mapInArrow(_count(path, id_column, budget, prefixes), schema)
