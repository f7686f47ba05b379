"""WAV and raw PCM files as blocks of 16-bit samples, and back.

Files are read through Spark's ``binaryFile`` source, so any store that Spark
reaches will do, one task a file batch; a file must fit a task, as its header comes
first. What comes out are blocks of bounded length with their place in the
stream, which is all that later operators need.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the format: tags for integers, floats and the extensible header, and the tail of its identifiers.
INTEGER, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
BLOCK = 4096
BLOCKS = "path string, rate int, channels int, channel int, block bigint, samples array<smallint>, error string"


@dataclass
class Format:
    tag: int
    channels: int
    rate: int
    bits: int
    data: bytes


def probe(raw: bytes) -> Format:
    """The first format and data chunk of a RIFF file; truncated chunks and odd sample widths are refused."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    end = 8 + struct.unpack_from("<I", raw, 4)[0]
    if end > len(raw):
        raise ValueError("file is truncated")
    at, fmt, data = 12, None, None
    while at + 8 <= end and (fmt is None or data is None):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("chunk is truncated")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and fmt is None:
            fmt = body
        elif name == b"data" and data is None:
            data = body
        at += 8 + size + size % 2
    if fmt is None or data is None or len(fmt) < 16:
        raise ValueError("format or data is missing")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if tag == EXTENSIBLE:
        if len(fmt) < 40:
            raise ValueError("extensible header is too short")
        valid, _, kind = struct.unpack_from("<HIH", fmt, 18)
        if fmt[26:40] != GUID_TAIL or valid != bits:
            raise ValueError("extensible header is not supported")
        tag = kind
    if bits % 8 or not channels or not rate:
        raise ValueError("sample layout is malformed")
    return Format(tag, channels, rate, bits, data)


def probe_strict(raw: bytes) -> Format:
    """The same for plain 16-bit integers only, by a walk over the whole file: the last format chunk counts, and the first data chunk.

    Any chunk that the file does not hold whole, any other format on the way, and data that are not whole frames are refused.
    """
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body, at = raw[at + 8 : at + 8 + size], at + 8 + size + size % 2
        if len(body) < size:
            raise ValueError("chunk is truncated")
        if name == b"fmt ":
            tag, channels, rate, bits = (*struct.unpack_from("<HHI", body), *struct.unpack_from("<H", body, 14)) if size >= 16 else (0, 0, 0, 0)
            if (tag, bits) != (INTEGER, 16) or not channels:
                raise ValueError("not plain 16-bit samples")
            fmt = channels, rate
        elif name == b"data" and data is None:
            data = body
    if fmt is None or data is None or not fmt[1] or not data or len(data) % (2 * fmt[0]):
        raise ValueError("format or whole frames are missing")
    return Format(INTEGER, *fmt, 16, data)


def normalize(data: bytes, tag: int, bits: int, channels: int) -> np.ndarray:
    """Frames by channels of 16-bit samples; halves go away from zero and the ends saturate."""
    step = bits // 8 * channels
    if (tag, bits) not in ((INTEGER, 16), (INTEGER, 24), (FLOAT, 32)):
        raise ValueError(f"samples of {bits} bits with tag {tag} are not supported")
    if not data or len(data) % step:
        raise ValueError("data is not whole frames")
    if bits == 16:
        return np.frombuffer(data, "<i2").reshape(-1, channels)
    if bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        s = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        s = np.where(s >= 1 << 23, s - (1 << 24), s)
        y = np.where(s >= 0, (s + 128) >> 8, -((-s + 128) >> 8))
    else:
        x = np.frombuffer(data, "<f4").astype(np.float64)
        if not np.isfinite(x).all():
            raise ValueError("sample is not finite")
        y = np.sign(x) * np.floor(np.abs(x) * 32768 + 0.5)
    return np.clip(y, -32768, 32767).astype(np.int16).reshape(-1, channels)


def _blocks(path: str, samples: np.ndarray, rate: int) -> Iterator[tuple]:
    for channel in range(samples.shape[1]):
        for block, at in enumerate(range(0, len(samples), BLOCK)):
            yield path, rate, samples.shape[1], channel, block, np.ascontiguousarray(samples[at : at + BLOCK, channel]), None


def _read(decode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.string())
        names = ["path", "rate", "channels", "channel", "block", "samples", "error"]
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    rows = list(_blocks(path, *decode(raw)))
                except ValueError as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_wav(spark: SparkSession, path: str, glob: str = "*.wav", strict: bool = False) -> DataFrame:
    """Blocks of samples of all WAV files under ``path``; a file that can't be read is a row with its error.

    With ``strict`` files are read as of ``probe_strict``.
    """

    def decode(raw: bytes):
        f = (probe_strict if strict else probe)(raw)
        return normalize(f.data, f.tag, f.bits, f.channels), f.rate

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(_read(decode), BLOCKS)


def read_raw(spark: SparkSession, path: str, rate: int, channels: int, layout: str = "s16le", glob: str = "*.pcm") -> DataFrame:
    """The same for headerless files of a stated layout: s16le, s24le or f32le."""
    tag, bits = {"s16le": (INTEGER, 16), "s24le": (INTEGER, 24), "f32le": (FLOAT, 32)}[layout]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(_read(lambda raw: (normalize(raw, tag, bits, channels), rate)), BLOCKS)


def samples(blocks: DataFrame) -> DataFrame:
    """path, channel, frame, sample of blocks without errors."""
    rows = blocks.where("error is null").select("path", "channel", "block", F.posexplode("samples").alias("k", "sample"))
    return rows.select("path", "channel", (F.col("block") * BLOCK + F.col("k")).alias("frame"), "sample")


def wav_bytes(frames: np.ndarray, rate: int) -> bytes:
    """A 44-byte header and interleaved 16-bit frames."""
    body = np.ascontiguousarray(frames, "<i2").tobytes()
    channels = frames.shape[1]
    if 36 + len(body) > 0xFFFFFFFF:
        raise ValueError("too long for a WAV file")
    head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, INTEGER, channels, rate, rate * channels * 2, channels * 2, 16)
    return head + struct.pack("<4sI", b"data", len(body)) + body


def to_wav(pcm: DataFrame, rate: int, stream: str = "path", total: int | None = None) -> DataFrame:
    """stream, body: each stream's samples (channel, frame, sample) as one WAV file; a gap or uneven channels is refused."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame", "ascending"), ("channel", "ascending")])
        channels = int(table["channel"].to_numpy().max()) + 1
        frame, s = table["frame"].to_numpy(), table["sample"].to_numpy()
        if len(s) % channels or (frame != np.repeat(np.arange(len(s) // channels), channels)).any():
            raise ValueError("samples are not whole, contiguous frames")
        frames = s.reshape(-1, channels)[:total]
        return pa.table({stream: table[stream][:1], "body": pa.array([wav_bytes(frames, rate)], pa.binary())})

    rows = pcm.select(stream, "channel", "frame", F.col("sample").cast("smallint").alias("sample"))
    return rows.groupBy(stream).applyInArrow(build, T.StructType([rows.schema[stream], T.StructField("body", T.BinaryType())]))


def write_files(rows: DataFrame, folder: str, name: str = "name", body: str = "body") -> int:
    """Write each body under its name to ``folder``, which driver and executors must have mounted; all files or none.

    Tasks write to a folder beside it, each file under a name of its own, so that a task that is run again
    does no harm; only when all have ended are the files moved. A job that fails leaves nothing.
    """
    staging = os.path.join(os.path.dirname(os.path.abspath(folder)), f".{os.path.basename(folder)}-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(staging, exist_ok=True)
        for batch in batches:
            parts = [uuid.uuid4().hex for _ in range(batch.num_rows)]
            for part, raw in zip(parts, batch[body].to_pylist()):
                with open(os.path.join(staging, part), "wb") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([batch[name], pa.array(parts, pa.string())], ["name", "part"])

    try:
        done = rows.select(name, body).mapInArrow(run, "name string, part string").collect()  # names, not bodies
        os.makedirs(folder, exist_ok=True)
        for r in done:
            os.replace(os.path.join(staging, r["part"]), os.path.join(folder, r["name"]))
        return len(done)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
