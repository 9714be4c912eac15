"""Words and word shingles of Arrow text columns as 64-bit numbers, computed for many texts at once with numpy.

Texts are taken as UTF-8 bytes. Word characters are told by byte, which is exact as long as every byte of 128 or more
belongs to a word, and A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are taken together up to so many bytes; a longer text is taken alone, and whole.
CHUNK_BYTES = 2_000_000

_rng = np.random.default_rng(8191)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP, _LONGER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers = np.ones(1, np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for every byte but those in the given ranges."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low:high + 1] = False
    return out


#: [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
NOT_SPACE = byte_set((32, 32), (9, 13))
LETTER_OR_DIGIT = byte_set((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _power_table(longest: int) -> np.ndarray:
    global _powers
    if len(_powers) < longest:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, _STEP)]))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets into them) of runs of rows."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the byte each begins at, and for each text the number of its first word (one more at the end)."""
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_of_texts = offsets[offsets < len(data)]
    begins[starts_of_texts] = inside[starts_of_texts]
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), at, first
    compact = np.cumsum(inside, dtype=np.int64)
    begin, total = compact[at] - 1, int(compact[-1])
    lengths = np.diff(begin, append=total)
    place = np.arange(total) - np.repeat(begin, lengths)
    values = _BYTE[data[inside]] * _power_table(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64)), at, first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words i to i + size - 1, for each i that has so many."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * _LONGER + words[j:j + n]
    return mix(out)


class Marks:
    """A set of hashes as a bitmap of fixed size: says yes for all its members, and for few others."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def marks_of(hashes: DataFrame, column: str, bits: int) -> Broadcast:
    """The bitmap of a column of hashes, sent to all tasks. Tasks make its pages; only those, of 4 kB, arrive here: the bitmap's
    size at most, whatever the number of hashes."""
    slot = (F.shiftrightunsigned(column, 64 - bits) + 1).alias("slot")
    pages = hashes.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    packed = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for row in pages.collect():
        packed[(row["page"] - 1) * 4096:row["page"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(Marks(packed, bits))
