"""Accounting, building and walking of packet streams and their chunked container."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

#: Fixed by the format: the 66-byte header's fields in order, and their bytes (all little-endian).
FIELDS = (
    ("format_tag", 2), ("channels", 2), ("sample_rate", 4), ("average_bytes", 4), ("block_align", 2), ("bits", 2),
    ("extra_size", 2), ("reserved", 2), ("channel_mask", 4), ("total_frames", 4), ("first_audio_offset", 4),
    ("data_size", 4), ("excess_high", 4), ("seek_size", 4), ("data_offset", 4), ("max_packet", 2), ("excess", 2),
    ("unknown_34", 4), ("unknown_38", 4), ("unknown_3c", 4), ("short_power", 1), ("long_power", 1),
)
HEADER = sum(n for _, n in FIELDS)


def little_endian(value: Column, size: int) -> Column:
    """The bytes of an unsigned integer, least significant first."""
    each = [F.lpad(F.hex(F.pmod(F.shiftright(value.cast("bigint"), 8 * k), F.lit(256))), 2, "0") for k in range(size)]
    return F.unhex(F.concat(*each))


def read_little_endian(body: Column, at: int, size: int) -> Column:
    """The unsigned integer in ``size`` bytes from byte ``at`` (from 0)."""
    digits = F.hex(F.substring(body, at + 1, size))
    turned = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("bigint")


def pack_header(**values: Column) -> Column:
    """The 66-byte header; fields not given are 0."""
    return F.concat(*(little_endian(values.get(name, F.lit(0)), size) for name, size in FIELDS))


def parse_header(body: Column) -> Column:
    """The header's fields as a struct; a header of another length is refused."""
    at, out = 0, []
    for name, size in FIELDS:
        out.append(read_little_endian(body, at, size).alias(name))
        at += size
    return F.when(F.octet_length(body) == HEADER, F.struct(*out)).otherwise(F.raise_error(F.lit("header is malformed")))


def accounting(packets: DataFrame, rate: int, frames: Column, seek: int = 0, short: int = 256, long: int = 2048, stream: str = "stream") -> DataFrame:
    """Derived sizes of each stream of packets (seq 0: setup).

    data_size, first_audio_offset, max_packet, rendered frames, terminal excess over
    ``frames`` (an expression over the others) and average bytes a second, rounded down.
    """
    first = F.min("seq").over(W.partitionBy(stream))
    rows = packets.withColumn("audio", F.col("seq") > first)
    bs = F.when(F.col("mode") == 1, long).otherwise(short)
    w = W.partitionBy(stream, "audio").orderBy("seq")
    rows = rows.withColumn("step", F.when(F.col("audio"), (bs + F.lag(bs).over(w)) / 4).cast("bigint"))
    out = rows.groupBy(stream).agg(
        (F.sum(F.col("size") + 2) + seek).alias("data_size"),
        (F.max(F.when(~F.col("audio"), F.col("size"))) + 2 + seek).alias("first_audio_offset"),
        F.max(F.when(F.col("audio"), F.col("size"))).alias("max_packet"),
        F.coalesce(F.sum("step"), F.lit(0)).alias("rendered"),
        F.count_if(F.col("audio") & (F.col("mode") == 0)).alias("short_blocks"),
        F.count_if(F.col("audio") & (F.col("mode") == 1)).alias("long_blocks"),
    )
    out = out.withColumn("frames", frames.cast("bigint"))
    over = F.greatest(F.lit(0), F.col("rendered") - F.col("frames"))
    out = out.withColumn("excess", F.when(over <= 0xFFFF, over).otherwise(F.raise_error(F.lit("excess does not fit"))))
    return out.withColumn("average_bytes", F.when(F.col("frames") > 0, F.floor(F.col("data_size") * rate / F.col("frames"))))


def build_stream(packets: DataFrame, seek: bytes = b"", stream: str = "stream") -> DataFrame:
    """stream, body: the seek table, then size and bytes of each packet in order. A packet over 65,535 bytes is refused."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        parts = [seek]
        for payload in table["payload"].to_pylist():
            if len(payload) > 0xFFFF:
                raise ValueError("packet is too large")
            parts += [struct.pack("<H", len(payload)), payload]
        return pa.table({stream: table[stream][:1], "body": pa.array([b"".join(parts)], pa.binary())})

    rows = packets.select(stream, "seq", "payload")
    return rows.groupBy(stream).applyInArrow(join, T.StructType([rows.schema[stream], T.StructField("body", T.BinaryType())]))


def walk_stream(streams: DataFrame, seek: int = 0, stream: str = "stream") -> DataFrame:
    """stream, seq, position, payload of each packet; ``error`` tells where a walk broke off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch[stream].to_pylist(), batch["body"].to_pylist()):
                at, seq = seek, 0
                if seek > len(data):
                    rows.append((key, None, 0, None, "seek table is larger than the data"))
                    continue
                while at + 2 <= len(data):
                    (n,) = struct.unpack_from("<H", data, at)
                    if at + 2 + n > len(data):
                        rows.append((key, seq, at, None, f"packet of {n} bytes overruns"))
                        break
                    rows.append((key, seq, at, data[at + 2 : at + 2 + n], None))
                    at, seq = at + 2 + n, seq + 1
                else:
                    if at != len(data):
                        rows.append((key, seq, at, None, "trailing bytes"))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            names = [stream, "seq", "position", "payload", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return streams.select(stream, "body").mapInArrow(run, f"{stream} bigint, seq bigint, position bigint, payload binary, error string")


def riff(kind: bytes, chunks: list[tuple[bytes, bytes]], big: bool = False, pad_last: bool = False) -> bytes:
    """A chunked file; odd chunks are padded, the last only if asked."""
    order = ">" if big else "<"
    body = kind
    for i, (name, data) in enumerate(chunks):
        body += name + struct.pack(order + "I", len(data)) + data
        if len(data) % 2 and (pad_last or i < len(chunks) - 1):
            body += b"\0"
    return (b"RIFX" if big else b"RIFF") + struct.pack(order + "I", len(body)) + body


def riff_chunks(data: bytes) -> tuple[bytes, bool, list[tuple[bytes, int, bytes]]]:
    """Kind, byte order and (name, declared size, bytes) of each chunk; a clipped last chunk is returned as it is."""
    if data[:4] not in (b"RIFF", b"RIFX") or len(data) < 12:
        raise ValueError("not a chunked file")
    big = data[:4] == b"RIFX"
    order, at, out = ">" if big else "<", 12, []
    while at + 8 <= len(data):
        (n,) = struct.unpack_from(order + "I", data, at + 4)
        out.append((data[at : at + 4], n, data[at + 8 : at + 8 + n]))
        at += 8 + n + n % 2
    return data[8:12], big, out


def build_container(streams: DataFrame, header: str = "header", body: str = "body", big: bool = False, extra: list[tuple[bytes, bytes]] = ()) -> DataFrame:
    """``streams`` with ``file``: header, further chunks and packet stream as a chunked file. The header stays little-endian in either order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch[header].to_pylist(), batch[body].to_pylist())
            out = [riff(b"WAVE", [(b"fmt ", h), *extra, (b"data", d)], big) for h, d in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "file"])

    schema = T.StructType([*streams.schema.fields, T.StructField("file", T.BinaryType())])
    return streams.mapInArrow(run, schema)


def load_container(files: DataFrame, stream: str = "stream", body: str = "file") -> DataFrame:
    """stream, header, body, extra (names of other chunks), error of each chunked file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch[stream].to_pylist(), batch[body].to_pylist()):
                try:
                    kind, _, chunks = riff_chunks(raw)
                    first = {}
                    for name, size, data in chunks:
                        if len(data) < size:
                            raise ValueError("chunk is truncated")
                        first.setdefault(name, data)
                    if kind != b"WAVE" or b"fmt " not in first or b"data" not in first:
                        raise ValueError("header or data is missing")
                    if len(first[b"fmt "]) != HEADER:
                        raise ValueError("header is malformed")
                    extra = [n.decode("latin-1") for n, _, _ in chunks if n not in (b"fmt ", b"data")]
                    rows.append((key, first[b"fmt "], first[b"data"], extra, None))
                except ValueError as e:
                    rows.append((key, None, None, None, str(e)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(stream).type, pa.binary(), pa.binary(), pa.list_(pa.string()), pa.string())
            names = [stream, "header", "body", "extra", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rest = [("header", T.BinaryType()), ("body", T.BinaryType()), ("extra", T.ArrayType(T.StringType())), ("error", T.StringType())]
    schema = T.StructType([files.schema[stream], *(T.StructField(n, k) for n, k in rest)])
    return files.select(stream, body).mapInArrow(run, schema)


def compare_bytes(a: DataFrame, b: DataFrame, key: str, body: str = "file") -> DataFrame:
    """key, same, first (offset of the first byte that differs; the shorter length if one is a beginning of the other)."""
    both = a.select(key, F.col(body).alias("_a")).join(b.select(key, F.col(body).alias("_b")), key, "full")

    @pandas_udf("bigint")
    def offset(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            if p is None or q is None or p == q:
                out.append(None if p is not None and p == q else 0)
                continue
            n = min(len(p), len(q))
            differ = np.flatnonzero(np.frombuffer(p[:n], np.uint8) != np.frombuffer(q[:n], np.uint8))
            out.append(int(differ[0]) if len(differ) else n)
        return pd.Series(out, dtype="Int64")

    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return both.select(key, same.alias("same"), F.when(~same, offset("_a", "_b")).alias("first"))
