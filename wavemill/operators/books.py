"""Codebooks: prefix codes with lattice vectors, their stored form, and bit fields that are read and written by one description."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wavemill.operators import entropy


class Bits:
    """A stream of bits, least significant first, that is either written (``Bits()``) or read (``Bits(data)``).

    ``field`` does whichever it is, so one walk over a layout packs and parses it.
    """

    def __init__(self, data: bytes | None = None) -> None:
        self.reading = data is not None
        self.data = bytearray(data or b"")
        self.at = 0

    def field(self, bits: int, value: int | None = None, less: int = 0) -> int:
        """An unsigned number of ``bits`` bits, stored ``less`` lower than it is."""
        if self.reading:
            return self.get(bits) + less
        self.put(value - less, bits)
        return value

    def put(self, value: int, bits: int) -> None:
        if not 0 <= bits <= 32 or not 0 <= value < 1 << bits:
            raise ValueError(f"{value} does not fit {bits} bits")
        first, shift = self.at >> 3, self.at & 7
        size = (shift + bits + 7) >> 3
        self.data.extend(bytes(max(0, first + size - len(self.data))))
        word = int.from_bytes(self.data[first : first + size], "little") | value << shift
        self.data[first : first + size] = word.to_bytes(size, "little")
        self.at += bits

    def get(self, bits: int) -> int:
        if bits > self.left:
            raise EOFError("end of packet")
        first, shift = self.at >> 3, self.at & 7
        word = int.from_bytes(self.data[first : first + ((shift + bits + 7) >> 3)], "little")
        self.at += bits
        return word >> shift & ((1 << bits) - 1)

    @property
    def left(self) -> int:
        return 8 * len(self.data) - self.at

    def tobytes(self) -> bytes:
        return bytes(self.data)


def width_of(n: int) -> int:
    """Bits that hold ``n``; none for 0."""
    return n.bit_length()


#: Fixed by the format: how many bits of a packed float are mantissa, and the bias of its exponent.
MANTISSA, BIAS = 21, 788


def unpack_float(word: int) -> float:
    """A 32-bit packed float: sign, 10 bits of exponent, 21 bits of mantissa."""
    value = float(word & ((1 << MANTISSA) - 1)) * 2.0 ** ((word >> MANTISSA & 0x3FF) - BIAS)
    return -value if word >> 31 else value


def pack_float(value: float) -> int:
    """The packed float nearest to ``value``."""
    mantissa, power = np.frexp(abs(value))
    mantissa, power = int(round(float(mantissa) * (1 << MANTISSA - 1))), int(power) - (MANTISSA - 1)
    return (value < 0) << 31 | ((power + BIAS) << MANTISSA if mantissa else 0) | mantissa


@dataclass(frozen=True)
class Book:
    """A prefix code over entries (length 0: unused) and, with ``values``, a lattice vector of ``dim`` numbers for each."""

    dim: int
    lengths: tuple[int, ...]
    values: tuple[int, ...] = ()
    low: float = 0.0
    step: float = 1.0
    sequence: bool = False

    @cached_property
    def codes(self) -> list[int | None]:
        return entropy.codewords(list(self.lengths))

    @cached_property
    def tree(self) -> dict[tuple[int, int], int]:
        return {(n, c): i for i, (n, c) in enumerate(zip(self.lengths, self.codes)) if c is not None}

    @cached_property
    def used(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.lengths) > 0)

    @cached_property
    def vectors(self) -> np.ndarray:
        """The vector of each entry: its digits in base ``len(values)``, least first, scaled; running sums if ``sequence``."""
        digits = np.arange(len(self.lengths))[:, None] // len(self.values) ** np.arange(self.dim) % len(self.values)
        scaled = np.array(self.values, np.float64)[digits] * self.step + self.low
        return np.cumsum(scaled, axis=1) if self.sequence else scaled

    def write(self, io: Bits, entry: int) -> None:
        if not 0 <= entry < len(self.lengths) or not self.lengths[entry]:
            raise ValueError(f"entry {entry} has no codeword")
        size = self.lengths[entry]
        # A codeword goes out from its top bit, as the tree is walked.
        io.put(int(format(self.codes[entry], f"0{size}b")[::-1], 2), size)

    def read(self, io: Bits) -> int:
        code = 0
        for size in range(1, 33):
            code = code << 1 | io.get(1)
            if (entry := self.tree.get((size, code))) is not None:
                return entry
        raise ValueError("no such codeword")

    def code(self, io: Bits, entry: int | None = None) -> int:
        if io.reading:
            return self.read(io)
        self.write(io, entry)
        return entry

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """The used entry at the least squared distance of each point, the lowest on ties."""
        out = np.zeros(len(points), np.int64)
        book = self.vectors[self.used]
        for a in range(0, len(points), 4096):
            p = points[a : a + 4096]
            out[a : a + len(p)] = self.used[((p[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)]
        return out

    def nearest_used(self, value: int) -> int:
        """The used entry whose number is nearest, the lowest on ties."""
        return int(self.used[np.abs(self.used - value).argmin()])


def stored(io: Bits, book: Book | None = None) -> Book:
    """The stored form of a codebook: written, or read into a book.

    Lengths are stored as runs where they only grow, else one by one, with a bit each where some entries are unused. Lattice values
    have as many bits as the largest needs.
    """
    dim = io.field(4, book and book.dim)
    n = io.field(14, book and len(book.lengths))
    grows = book is not None and n > 0 and book.lengths[0] > 0 and list(book.lengths) == sorted(book.lengths)
    if io.field(1, int(grows)):
        size = io.field(5, book and book.lengths[0], less=1)
        lengths: list[int] = []
        while len(lengths) < n:
            run = io.field(width_of(n - len(lengths)), book and book.lengths.count(size))
            lengths += [size] * run
            size += 1
            if size > 33 or len(lengths) > n:
                raise ValueError("codebook is malformed")
    else:
        size = io.field(3, book and width_of(max(book.lengths, default=0)))
        sparse = io.field(1, book and int(0 in book.lengths))
        lengths = []
        for i in range(n):
            own = book.lengths[i] if book else None
            there = io.field(1, own and 1 or 0) if sparse else 1
            lengths.append(io.field(size, own, less=1) if there else 0)
    if not io.field(1, book and int(bool(book.values))):
        return Book(dim, tuple(lengths))
    low = io.field(32, book and pack_float(book.low))
    step = io.field(32, book and pack_float(book.step))
    bits = io.field(4, book and max(1, width_of(max(book.values))), less=1)
    sequence = bool(io.field(1, book and int(book.sequence)))
    count = entropy.quantvals(n, dim)
    if book and len(book.values) != count:
        raise ValueError(f"a lattice of {n} entries in {dim} dimensions has {count} values")
    values = tuple(io.field(bits, book.values[i] if book else None) for i in range(count))
    return Book(dim, tuple(lengths), values, unpack_float(low), unpack_float(step), sequence)


def pack_book(book: Book) -> bytes:
    io = Bits()
    stored(io, book)
    return io.tobytes()


def parse_book(data: bytes) -> Book:
    return stored(Bits(data))


def load_books(ids: DataFrame, table: DataFrame, book_id: str = "book_id") -> DataFrame:
    """``ids`` with the stored form of each codebook from ``table`` (book_id, body); a missing one is refused.

    Codebook tables hold a few hundred rows, so they are counted by their reader and broadcast.
    """
    found = ids.join(F.broadcast(table), book_id, "left")
    body = F.when(F.col("body").isNotNull(), F.col("body")).otherwise(F.raise_error(F.lit("no such codebook")))
    return found.withColumn("body", body)


def coded(symbols: Column, book: Book) -> Column:
    """Each array of entries as a bit stream: a struct of the bytes and the number of bits."""

    @pandas_udf("payload binary, bits bigint")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            io = Bits()
            for entry in row:
                book.write(io, int(entry))
            out.append((io.tobytes(), io.at))
        return pd.DataFrame(out, columns=["payload", "bits"])

    return run(symbols)


def decoded(payload: Column, count: Column, book: Book) -> Column:
    """The first ``count`` entries of each bit stream."""

    @pandas_udf("array<int>")
    def run(rows: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for row, n in zip(rows, counts):
            io = Bits(row)
            out.append([book.read(io) for _ in range(n)])
        return pd.Series(out, dtype=object)

    return run(payload, count)


def vector_of(entry: Column, book: Book) -> Column:
    """The lattice vector of an entry, in expressions."""
    count, out = len(book.values), []
    values = F.array(*(F.lit(float(v)) for v in book.values))
    for k in range(book.dim):
        digit = F.pmod(F.floor(entry / count**k), F.lit(count)).cast("int")
        own = F.element_at(values, digit + 1) * book.step + book.low
        out.append(out[-1] + own if book.sequence and out else own)
    return F.array(*out)
