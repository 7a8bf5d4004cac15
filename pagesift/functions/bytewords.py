"""Words and their hashes for many texts at once, on the UTF-8 bytes of an Arrow column.

A column is cut into slices of whole texts of about SLICE_BYTES (a longer text is a slice of its
own), so memory is bounded by the slice, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 * 1024 * 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


#: one code per byte; A-Z as a-z
BYTE_CODES = _byte_codes()


def powers(count: int, inverse: bool = False) -> np.ndarray:
    have = _powers[inverse]
    if len(have) < count:
        step = np.full(max(count, 2 * SLICE_BYTES), _BASE_INVERSE if inverse else _BASE)
        step[0] = 1
        _powers[inverse] = have = np.cumprod(step)
    return have[:count]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    chosen = np.zeros(256, bool)
    for low, high in ranges:
        chosen[low : high + 1] = True
    return chosen


#: everything but space and \t \n \v \f \r
NOT_SPACE = ~byte_set((0x09, 0x0D), (0x20, 0x20))
#: digits, letters and every byte of a character beyond ASCII
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def slices(
    texts: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows and of the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, members: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes that no text end cuts through, and the index
    of the first word of each text (one entry more than texts)."""
    inside = members[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running sums of which the difference of two gives the hash of what lies between."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes (A-Z as a-z)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive word hashes; empty if there are fewer."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total *= _BASE
        total += words[k : k + count]
    return mix(total)
