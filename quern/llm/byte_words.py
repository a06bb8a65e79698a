"""Words of Arrow text columns, found and hashed in their UTF-8 buffers by numpy: a table of 256 entries says which
bytes belong to words, differences of neighbouring bytes' classes give starts and ends, and hashes advance byte by
byte over all words at once. Only words of over LONG bytes leave that path, each by one call for its rest."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a word that are advanced together with those of all others.
LONG = 64
#: Bytes of text that are looked at together; a longer text is looked at on its own.
BLOCK_BYTES = 4 << 20

#: A-Z as a-z, every other byte as itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def letters(*without: tuple[int, int]) -> np.ndarray:
    """The table of bytes that belong to words: all but those of the given ranges, ends included."""
    found = np.ones(256, bool)
    for low, high in without:
        found[low : high + 1] = False
    return found


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes in lower case, offsets of the rows in them) of runs of rows of about ``most`` bytes."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, LOWER[data[ends[row] : ends[last]]], ends[row : last + 1] - ends[row]
        row = last


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word; no word goes on from one row into the next."""
    inside = table[data]
    change = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    crossed = np.unique(inner[inside[inner - 1] & inside[inner]]) if len(inner) else inner
    if len(crossed):
        starts, ends = np.sort(np.concatenate([starts, crossed])), np.sort(np.concatenate([ends, crossed]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def by_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The words from the longest to the shortest, and how many have more than 0, 1, 2, … bytes, up to LONG."""
    sizes = np.minimum(ends - starts, LONG + 1).astype(np.uint8)
    order = np.argsort(255 - sizes, kind="stable")
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=LONG + 2))
    return order, [int(n) for n in longer[:LONG] if n]


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, alive: list[int], step: Callable, rest: Callable) -> np.ndarray:
    """Each word's state after its bytes: all words that still have a byte take one step together."""
    own, at = state[order], starts[order]
    for k, m in enumerate(alive):
        own[:m] = step(own[:m], data[at[:m] + k])
    out = np.empty_like(own)
    out[order] = own
    for i in order[: np.count_nonzero(ends - starts > LONG)]:
        out[i] = rest(data[starts[i] + LONG : ends[i]].tobytes(), int(out[i]))
    return out


def crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def crc_rest(data: bytes, state: int) -> int:
    return zlib.crc32(data, state ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, crc) of all runs of 1, 2, … ``longest`` consecutive words of a row, joined by one space, in order of their
    last words. A run's state goes on from that of the run of one word fewer before its last word."""
    order, alive = by_length(starts, ends)
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends, order, alive, crc_step, crc_rest)
    yield row, state ^ np.uint32(0xFFFFFFFF)
    for words in range(2, longest + 1):
        before = np.concatenate([state[:1], crc_step(state[:-1], np.uint8(32))])
        state = advance(before, data, starts, ends, order, alive, crc_step, crc_rest)
        whole = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1]) + words - 1
        yield row[whole], state[whole] ^ np.uint32(0xFFFFFFFF)


def fnv_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (state ^ byte) * np.uint64(0x100000001B3)


def fnv_rest(data: bytes, state: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, state)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: FNV-1a, and XXH64 of what is beyond LONG bytes."""
    order, alive = by_length(starts, ends)
    return advance(np.full(len(starts), 0xCBF29CE484222325, np.uint64), data, starts, ends, order, alive, fnv_step, fnv_rest)
