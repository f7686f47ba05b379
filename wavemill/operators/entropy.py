"""Codebooks, prefix codes and bit streams, least significant bit first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def codewords(lengths: list[int]) -> list[int | None]:
    """The codeword of each entry: the lowest free leaf of its length. Over-populated and under-populated trees are refused."""
    free: list[tuple[str, int]] = [("", 0)]  # free nodes by their path, leftmost first
    out: list[int | None] = []
    used = [n for n in lengths if n > 0]
    if len(used) == 1:
        return [0 if n > 0 else None for n in lengths]
    for n in lengths:
        if n <= 0:
            out.append(None)
            continue
        fits = [x for x in free if x[1] <= n]
        if not fits:
            raise ValueError("prefix code is over-populated")
        # The leftmost leaf of that depth that is free.
        path, depth = min(fits, key=lambda x: x[0].ljust(64, "0"))
        free.remove((path, depth))
        while depth < n:
            heapq.heappush(free, (path + "1", depth + 1))
            path, depth = path + "0", depth + 1
        out.append(int(path, 2))
    if free and used:
        raise ValueError("prefix code is under-populated")
    return out


def lattice(entry: int, dim: int, quantvals: int, low: float, step: float, multipliers: list[int], sequence: bool = False) -> list[float]:
    """The vector of a lattice entry: digits of the entry in base ``quantvals``, scaled; running sums if ``sequence``."""
    out, last = [], 0.0
    for _ in range(dim):
        v = multipliers[entry % quantvals] * step + low + last
        entry //= quantvals
        last = v if sequence else 0.0
        out.append(v)
    return out


def quantvals(entries: int, dim: int) -> int:
    """The greatest v with v ** dim <= entries."""
    v = int(round(entries ** (1 / dim)))
    while v**dim > entries:
        v -= 1
    while (v + 1) ** dim <= entries:
        v += 1
    return v


class BitWriter:
    """Bits into bytes, least significant first."""

    def __init__(self) -> None:
        self.value, self.length = 0, 0

    def write(self, value: int, bits: int) -> None:
        if not 0 <= bits <= 32 or value >> bits:
            raise ValueError(f"{value} does not fit {bits} bits")
        self.value |= value << self.length
        self.length += bits

    def write_code(self, code: int, bits: int) -> None:
        """A codeword goes out from its top bit, as the tree is walked."""
        self.write(int(format(code, f"0{bits}b")[::-1], 2), bits)

    def tobytes(self) -> bytes:
        return self.value.to_bytes(-(-self.length // 8), "little")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def read(self, bits: int) -> int:
        if bits > self.left:
            raise EOFError("end of packet")
        out = self.value & ((1 << bits) - 1)
        self.value >>= bits
        self.left -= bits
        return out

    def read_code(self, tree: dict[tuple[int, int], int]) -> int:
        code = n = 0
        while True:
            code, n = (code << 1) | self.read(1), n + 1
            if (n, code) in tree:
                return tree[n, code]
            if n > 32:
                raise ValueError("no such codeword")


def _with(rows: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField(name, kind)])


def encode_symbols(rows: DataFrame, lengths: list[int], symbols: str = "symbols", name: str = "payload") -> DataFrame:
    """``rows`` with ``name``: each array of symbols as a prefix-coded bit stream. Codes are a constant of the book."""
    codes = codewords(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch[symbols].to_pylist():
                w = BitWriter()
                for s in row or ():
                    if not 0 <= s < len(codes) or codes[s] is None:
                        raise ValueError(f"entry {s} has no codeword")
                    w.write_code(codes[s], lengths[s])
                out.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    return rows.mapInArrow(run, _with(rows, name, T.BinaryType()))


def decode_symbols(rows: DataFrame, lengths: list[int], count: str, payload: str = "payload", name: str = "decoded") -> DataFrame:
    """``rows`` with ``name``: the first ``count`` symbols of each bit stream."""
    tree = {(n, c): i for i, (n, c) in enumerate(zip(lengths, codewords(lengths))) if c is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, n in zip(batch[payload].to_pylist(), batch[count].to_pylist()):
                r = BitReader(body)
                out.append([r.read_code(tree) for _ in range(n)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, name])

    return rows.mapInArrow(run, _with(rows, name, T.ArrayType(T.IntegerType())))


#: A book whose lengths come in at most so many runs is a few comparisons; any other is a table that is joined.
RUNS = 32


def bit_cost(rows: DataFrame, lengths: list[int], keys: tuple[str, ...], symbol: str = "symbol") -> DataFrame:
    """bits, bytes a group of symbols takes; a symbol without a codeword is refused."""
    ends = [i for i in range(1, len(lengths) + 1) if i == len(lengths) or lengths[i] != lengths[i - 1]]
    if len(ends) <= RUNS:
        size = F.when(F.col(symbol) < 0, 0)
        for end in ends:
            size = size.when(F.col(symbol) < end, lengths[end - 1])
        size = size.otherwise(0)
    else:
        # One row an entry: a book has 2^14 at most.
        table = rows.sparkSession.createDataFrame(list(enumerate(lengths)), "_entry bigint, _bits int")
        rows = rows.join(F.broadcast(table), F.col(symbol) == F.col("_entry"), "left")
        size = F.coalesce("_bits", F.lit(0))
    size = F.when(size > 0, size).otherwise(F.raise_error(F.lit("entry has no codeword")))
    out = rows.groupBy(*keys).agg(F.sum(size.cast("bigint")).alias("bits"))
    return out.withColumn("bytes", F.ceil(F.col("bits") / 8))


def balanced_lengths(n: int) -> list[int]:
    """A complete code of ``n`` entries whose lengths differ by one at most, short ones first."""
    if n == 1:
        return [1]
    depth = int(np.ceil(np.log2(n)))
    short = (1 << depth) - n
    return [depth - 1] * short + [depth] * (n - short)
