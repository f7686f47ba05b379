"""Encode and decode of sample streams as packets of lapped blocks, with a profile of our own.

The plan is relational: transients are flagged per quantum of 64 samples by
aggregation, block modes come from one narrow ordered scan per stream (a row a
quantum, not a sample), and from there every block is on its own: samples are gathered by
place, and packets are made in Arrow batches. Decoding takes packets apart in any
order; a block's window needs its neighbours' modes only, and overlap-add is a sum by
place. So one long stream uses all tasks both ways.

A packet: 1 bit of mode; per channel 1 bit whether it has a floor, its posts as 8-bit
levels; then per partition of 16 bins and channel 5 bits of width and the
residues in two's complement of that width. Channels 0 and 1 are coupled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.operators import schedule, spectral

SHORT, LONG, QUANTUM = 256, 2048, 64
SIZES = (SHORT, LONG)
PARTITION = 16
#: Frames that are met in one place.
STRETCH = 16_384
#: Streams under this many frames are refused, as they hold no whole long block with its neighbours.
LEAST_FRAMES = 4096
#: A quantum whose energy is this many times the mean of the 8 before it is a transient.
RISE = 16.0
_AMPLITUDE = 10.0 ** (7 * (np.arange(256) - 255) / 256)


def transient_slots(pcm: DataFrame) -> DataFrame:
    """stream, q, slot: quanta with a sudden rise of energy in any channel."""
    s = F.col("sample") / 32768.0
    energy = pcm.groupBy("stream", "channel", F.floor(F.col("frame") / QUANTUM).alias("q")).agg(F.sum(s * s).alias("e"))
    before = F.avg("e").over(W.partitionBy("stream", "channel").orderBy("q").rowsBetween(-8, -1))
    rise = F.coalesce(F.col("e") > RISE * before + 1e-4, F.lit(False))
    return energy.withColumn("r", rise.cast("int")).groupBy("stream", "q").agg(F.max("r").alias("slot"))


def reach(current: int, centre: int) -> int:
    """The last frame, and one, that the choice of the block after one of mode ``current`` at ``centre`` looks at."""
    return SIZES[current] // 4 + centre + LONG // 2 + SHORT // 4


def following_mode(slots: np.ndarray, first: int, current: int, centre: int, cursor: int) -> tuple[int, int]:
    """The mode of the next block (1: long) and where the scan stopped; a transient within its reach makes it short.

    ``slots`` are those of the quanta from ``first``; what is beyond them has none.
    """
    begin = max(cursor, centre) // QUANTUM
    seen = slots[max(0, begin - first) : max(0, -(-reach(current, centre) // QUANTUM) - first)]
    at = (np.flatnonzero(seen) + max(begin, first)) * QUANTUM
    at = at[at > centre]
    return (0, int(at[0])) if len(at) else (1, cursor)


def scan_modes(slots: np.ndarray, frames: int) -> list[int]:
    """Modes of successive blocks (1: long). The first is short."""
    modes, current, centre, cursor = [0], 0, 0, 0
    while centre < frames:
        following, cursor = following_mode(slots, 0, current, centre, cursor)
        centre += SIZES[current] // 4 + SIZES[following] // 4
        modes.append(following)
        current = following
    return modes


def block_modes(pcm: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """stream, seq, mode, frames: one ordered scan per stream over its quanta."""
    frames = pcm.groupBy("stream").agg((F.max("frame") + 1).alias("frames"))
    rows = transient_slots(pcm).join(frames, "stream")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["frames"].iloc[0])
        if total < least:
            raise ValueError(f"a stream has {total} frames; {least} are needed")
        slots = np.zeros(-(-total // QUANTUM), np.int64)
        slots[pdf["q"].to_numpy()] = pdf["slot"].to_numpy()
        modes = scan_modes(slots, total)
        return pd.DataFrame({"stream": pdf["stream"].iloc[0], "seq": np.arange(len(modes)), "mode": modes, "frames": total})

    return rows.groupBy("stream").applyInPandas(run, "stream bigint, seq bigint, mode int, frames bigint")


@lru_cache(maxsize=16)
def slopes(n: int, left: int, right: int) -> np.ndarray:
    """A block's window between neighbours of ``left`` and ``right`` samples."""
    l, r = min(n, left), min(n, right)
    out = np.zeros(n)
    lb, rb = n // 4 - l // 4, 3 * n // 4 - r // 4
    out[lb : lb + l // 2] = spectral.window(l)[: l // 2]
    out[lb + l // 2 : rb] = 1
    out[rb : rb + r // 2] = spectral.window(r)[r // 2 :]
    return out


def spectrum(block: np.ndarray, previous: int, following: int) -> np.ndarray:
    """Coefficients of a block (channels by samples) between neighbours of these modes."""
    n = block.shape[1]
    return spectral.lapped(block * slopes(n, SIZES[previous], SIZES[following])) * (4.0 / n)


def windowed(spectra: np.ndarray, previous: int, following: int) -> np.ndarray:
    """What a block of these coefficients adds to the timeline."""
    n = 2 * spectra.shape[1]
    return spectral.unlapped(spectra) * slopes(n, SIZES[previous], SIZES[following])


@lru_cache(maxsize=4)
def post_bins(n: int) -> np.ndarray:
    """Where a floor has posts: ends, and between them ever wider apart."""
    half = n // 2
    inner = np.unique(np.round(half ** np.linspace(0.2, 1, 18)).astype(int))
    return np.unique(np.concatenate([[0], inner[inner < half], [half - 1]]))


def floor_levels(spectra: np.ndarray, posts: np.ndarray) -> np.ndarray:
    """8-bit levels of the strongest bin around each post (rows); level 255 is 1, each step 7 / 256 of a decade."""
    edges = np.concatenate([[0], (posts[1:] + posts[:-1]) // 2 + 1])
    peak = np.maximum.reduceat(np.abs(spectra), edges, axis=-1)
    return np.clip(np.ceil(255 + np.log10(np.maximum(peak, 1e-9)) * 256 / 7), 0, 255).astype(np.int64)


def render(levels: np.ndarray, posts: np.ndarray, n: int) -> np.ndarray:
    """The floor's amplitude in every bin (rows): integer lines between posts."""
    x = np.arange(n // 2)
    k = np.clip(np.searchsorted(posts, x, side="right") - 1, 0, len(posts) - 2)
    low, rise, run = levels[..., k], levels[..., k + 1] - levels[..., k], posts[k + 1] - posts[k]
    y = low + np.sign(rise) * (np.abs(rise) * (x - posts[k]) // run)
    return _AMPLITUDE[y]


def couple(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer magnitude and angle from which ``uncouple`` gets the pair back."""
    wins = np.abs(first) > np.abs(second)
    m = np.where(wins, first, second)
    a = np.where(m > 0, first - second, second - first)
    return m, a


def uncouple(m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.where(m > 0, m - np.abs(a), m + np.abs(a))
    return np.where(a > 0, m, moved), np.where(a > 0, moved, m)


def pack(spectra: np.ndarray, mode: int, steps: float) -> bytes:
    """One packet from the coefficients of all channels (channels by bins)."""
    return pack_all(spectra[None], mode, steps)[0]


def pack_all(spectra: np.ndarray, mode: int, steps: float) -> list[bytes]:
    """Packets of blocks of one mode (blocks by channels by bins). ``steps``: levels of residue at the floor.

    All fields of all packets are laid out as values and widths, and become bits at once.
    """
    return [p for a in range(0, len(spectra), 64) for p in _packed(spectra[a : a + 64], mode, steps)]


def _packed(spectra: np.ndarray, mode: int, steps: float) -> list[bytes]:
    blocks, channels, half = spectra.shape
    posts = post_bins(2 * half)
    levels = floor_levels(spectra, posts)
    there = levels.any(axis=-1)
    residues = np.where(there[..., None], np.rint(spectra / render(levels, posts, 2 * half) * steps), 0).astype(np.int64)
    if channels > 1:
        residues[:, 0], residues[:, 1] = couple(residues[:, 0].copy(), residues[:, 1].copy())
    parts = residues.reshape(blocks, channels, -1, PARTITION).swapaxes(1, 2)
    # Bits that hold a partition in two's complement, none where it is silent.
    size = np.maximum(parts.max(axis=-1), -parts.min(axis=-1) - 1)
    width = np.where((parts != 0).any(axis=-1), np.frexp(np.maximum(size, 0).astype(np.float64))[1] + 1, 0)
    if width.max(initial=0) > 31:
        raise ValueError("residue is out of range")
    mask = (1 << width.astype(np.int64)) - 1
    body_value = np.concatenate([width[..., None], parts & mask[..., None]], axis=-1).reshape(blocks, -1)
    body_bits = np.concatenate([np.full((*width.shape, 1), 5), np.repeat(width[..., None], PARTITION, axis=-1)], axis=-1).reshape(blocks, -1)
    head_value = np.concatenate([there[..., None], levels], axis=-1).reshape(blocks, -1)
    head_bits = np.concatenate([np.ones((blocks, channels, 1), int), np.repeat(8 * there[..., None], len(posts), axis=-1)], axis=-1).reshape(blocks, -1)
    one = np.ones((blocks, 1), int)
    value, bits = np.concatenate([mode * one, head_value, body_value], axis=1), np.concatenate([one, head_bits, body_bits], axis=1)
    length = bits.sum(axis=1)
    value, bits = np.c_[value, 0 * one], np.c_[bits, (-length % 8)[:, None]]
    value, bits = value.ravel(), bits.ravel()
    begin = np.cumsum(bits) - bits
    at = np.arange(int(bits.sum())) - np.repeat(begin, bits)
    raw = np.packbits((np.repeat(value, bits) >> at & 1).astype(np.uint8), bitorder="little").tobytes()
    ends = np.concatenate([[0], np.cumsum((length + 7) // 8)]).tolist()
    return [raw[i:j] for i, j in zip(ends, ends[1:])]


def unpack(payload: bytes, channels: int, steps: float) -> tuple[int, np.ndarray]:
    """Mode and coefficients of a packet; one that ends early is malformed."""
    if not payload:
        raise ValueError("packet ends early")
    mode = payload[0] & 1
    return mode, unpack_all([payload], mode, channels, steps)[0]


def unpack_all(payloads: list[bytes], mode: int, channels: int, steps: float) -> np.ndarray:
    """Coefficients of packets of one mode (blocks by channels by bins).

    The packets are read in lockstep: each step takes one field of every packet, at its own place.
    """
    size = np.array([len(p) for p in payloads])
    raw = np.frombuffer(b"".join([*payloads, bytes(16)]), np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 8,), (1,))
    at = (np.cumsum(size) - size) * 8
    end, n, posts = at + size * 8, SIZES[mode], post_bins(SIZES[mode])
    at = at + 1

    def take(where: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        word = words[np.minimum(where >> 3, len(words) - 1)] >> (where & 7).astype(np.uint64)
        return word.astype(np.int64) & ((1 << bits) - 1)

    floors = np.zeros((len(payloads), channels, n // 2))
    for c in range(channels):
        there = take(at, 1).astype(bool)
        levels = take(at[:, None] + 1 + 8 * np.arange(len(posts)), 8)
        floors[there, c] = render(levels[there], posts, n)
        at = at + 1 + 8 * len(posts) * there
    residues = np.zeros((len(payloads), channels, n // 2), np.int64)
    for p in range(0, n // 2, PARTITION):
        for c in range(channels):
            width = take(at, 5)
            value = take(at[:, None] + 5 + width[:, None] * np.arange(PARTITION), width[:, None])
            sign = value >> np.maximum(width - 1, 0)[:, None] & 1
            residues[:, c, p : p + PARTITION] = value - np.where(width[:, None] > 0, sign << width[:, None], 0)
            at = at + 5 + PARTITION * width
    if (at > end).any():
        raise ValueError("packet ends early")
    if channels > 1:
        residues[:, 0], residues[:, 1] = uncouple(residues[:, 0].copy(), residues[:, 1].copy())
    return residues * floors / steps


def encode(pcm: DataFrame, channels: int, steps: float = 32.0, least: int = LEAST_FRAMES) -> DataFrame:
    """stream, seq, mode, frames, payload from (stream, channel, frame, sample).

    Samples are met in stretches of ``STRETCH`` frames: a stretch's blocks begin in it, and need it and the next one at most.
    """
    plan = schedule.plan(block_modes(pcm, least)).withColumn("start", F.col("sample_start") - LONG // 2)
    # The first block begins before the stream.
    place = F.greatest(F.floor(F.col("start") / STRETCH), F.lit(0)).cast("bigint")
    block = F.struct("seq", "previous", "mode", "following", "start")
    blocks = plan.groupBy("stream", place.alias("place")).agg(F.collect_list(block).alias("blocks"), F.first("frames").alias("frames"))
    key = F.floor(F.col("frame") / STRETCH)
    within = (F.pmod("frame", F.lit(STRETCH)) * channels + F.col("channel")).cast("int")
    parts = pcm.groupBy("stream", key.alias("place")).agg(F.collect_list(within).alias("at"), F.collect_list(F.col("sample").cast("smallint")).alias("s"))
    both = parts.select("stream", F.explode(F.array(F.col("place") - 1, F.col("place"))).alias("place"), F.col("place").alias("own"), "at", "s")
    both = both.where("place >= 0").groupBy("stream", "place").agg(F.collect_list(F.struct("own", "at", "s")).alias("parts"))
    rows = blocks.join(both, ["stream", "place"], "left").select("stream", "place", "frames", "blocks", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists, parts = [], batch["blocks"], batch["parts"]
            for i, (stream, place, frames) in enumerate(zip(*(batch[c].to_pylist() for c in ("stream", "place", "frames")))):
                base = place * STRETCH - LONG  # room for a block that begins before
                held = np.zeros((LONG + 2 * STRETCH) * channels)
                for k in range(len(parts[i].values) if parts[i].is_valid else 0):
                    part = parts[i].values[k]
                    first = (part["own"].as_py() * STRETCH - base) * channels
                    held[first + part["at"].values.to_numpy()] = part["s"].values.to_numpy() / 32768.0
                held = held.reshape(-1, channels).T
                b = lists[i].values
                seq, prev, mode, foll, start = (b.field(c).to_numpy() for c in ("seq", "previous", "mode", "following", "start"))
                for m in (0, 1):
                    own = np.flatnonzero(mode == m)
                    if not len(own):
                        continue
                    n = SIZES[m]
                    x = held[:, (start[own] - base)[:, None] + np.arange(n)].swapaxes(0, 1)
                    shape = np.stack([slopes(n, SIZES[prev[j]], SIZES[foll[j]]) for j in own])
                    packed = pack_all(spectral.lapped(x * shape[:, None]) * (4.0 / n), m, steps)
                    out += [(stream, int(seq[j]), m, frames, body) for j, body in zip(own, packed)]
            columns = list(zip(*out)) or [()] * 5
            kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), ["stream", "seq", "mode", "frames", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(run, "stream bigint, seq bigint, mode int, frames bigint, payload binary")


def decode(packets: DataFrame, channels: int, steps: float = 32.0) -> DataFrame:
    """stream, channel, frame, x (double) of (stream, seq, frames, payload): exactly ``frames`` frames.

    The mode of a block is the first bit of its packet; a packet that ends early is an error. Blocks are dealt to the
    stretches that they reach, and each stretch is the sum of its blocks.
    """
    mode = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1))
    plan = schedule.plan(packets.withColumn("mode", mode)).withColumn("start", F.col("sample_start") - LONG // 2)
    size = F.when(F.col("mode") == 1, LONG).otherwise(SHORT)
    first, last = F.greatest(F.floor(F.col("start") / STRETCH), F.lit(0)), F.floor((F.least(F.col("start") + size, F.col("frames")) - 1) / STRETCH)
    place = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("place")
    rows = plan.select("stream", place, "start", "previous", "mode", "following", "frames", "payload")

    def run(table: pa.Table) -> pa.Table:
        """One stretch of a stream from its packets; those that reach two stretches are taken apart in both."""
        base, frames = table["place"][0].as_py() * STRETCH, table["frames"][0].as_py()
        prev, mode, foll, start = (table[c].to_numpy() for c in ("previous", "mode", "following", "start"))
        bodies = table["payload"].to_pylist()
        count = min(STRETCH, frames - base)
        out = np.zeros((channels, LONG + STRETCH + LONG))
        for m in (0, 1):
            own = np.flatnonzero(mode == m)
            for a in range(0, len(own), 256):
                some = own[a : a + 256]
                n = SIZES[m]
                y = spectral.unlapped(unpack_all([bodies[j] for j in some], m, channels, steps))
                for j, one in zip(some, y):
                    at = int(start[j]) - base + LONG
                    out[:, at : at + n] += one * slopes(n, SIZES[prev[j]], SIZES[foll[j]])
        out = out[:, LONG : LONG + count]
        columns = {"stream": np.full(out.size, table["stream"][0].as_py()), "channel": np.repeat(np.arange(channels, dtype=np.int32), count)}
        return pa.table(columns | {"frame": np.tile(np.arange(base, base + count), channels), "x": out.ravel()})

    return rows.groupBy("stream", "place").applyInArrow(run, "stream bigint, channel int, frame bigint, x double")
