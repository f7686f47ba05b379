"""Whole Arrow columns of texts as numpy byte arrays: words, hashes, batches.

All hashing is 64-bit arithmetic modulo 2^64 over fixed pseudo-random values, so
any worker gets the same hash for the same bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes, which bounds the temporary arrays.
RUN_BYTES = 1 << 18
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    #: A value for each byte.
    BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)
    LOWER_BYTE = BYTE.copy()
    LOWER_BYTE[65:91] = BYTE[97:123]
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of the base and of its inverse, grown as needed, bounded by the longest run."""

    def __init__(self) -> None:
        self.up = self.down = powers(1, 0)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, RUN_BYTES)
            if n > 16 * RUN_BYTES:  # one giant text: not kept
                return powers(_BASE, n), powers(_BASE_INV, n)
            self.up, self.down = powers(_BASE, size), powers(_BASE_INV, size)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def tidy(run: Callable) -> Callable:
    """An Arrow pass after which its worker gives freed memory back: workers are kept for later stages."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return passed


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of up to ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of word bytes; no run crosses a text's border."""
    n = len(is_word)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(is_word & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_BYTE) -> np.ndarray:
    """A hash of the bytes of each span, by running sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        up, down = _POWERS.get(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * _STEP)


def word_table(*breaks: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but the given ranges."""
    out = np.ones(256, bool)
    for a, b in breaks:
        out[a : b + 1] = False
    return out


#: Words between white space, and words of letters, digits and non-ASCII characters.
SPACED = word_table((0x09, 0x0D), (0x20, 0x20))
ALNUM = word_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lower-cased), and where each text's words begin (one more than texts)."""
    starts, ends = word_spans(table[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
