"""Cutting ordered samples into frames, windowing and overlap-add.

Samples carry their place, so frames are made by arithmetic on it and met by
equi-joins or groups: a stream of any length is spread over all tasks, and nothing
needs a whole stream in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import numeric as N


#: Up to this many rows of a few numbers go to every executor; the others are met by a shuffle.
BROADCAST_ROWS = 100_000


def small_side(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast if they are counted to be few. A key of few values would send a large side to few tasks."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def sliding(samples: DataFrame, width: int, hop: int, frame: str = "frame", whole: bool = True, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """``samples`` with (q, pos): one row for each frame of ``width`` every ``hop`` that a sample is in.

    With ``whole`` only frames that lie wholly in the stream (by its last place).
    """
    at = F.col(frame)
    first = F.greatest(F.lit(0), F.floor((at - width + hop) / hop)).cast("bigint")
    rows = samples.withColumn("q", F.explode(F.sequence(first, F.floor(at / hop).cast("bigint"))))
    rows = rows.withColumn("pos", (at - F.col("q") * hop).cast("int"))
    if not whole:
        return rows
    last = samples.groupBy(*keys).agg(F.max(frame).alias("_last"))
    rows = rows.join(small_side(last), list(keys))
    return rows.where(F.col("q") * hop + width - 1 <= F.col("_last")).drop("_last")


def interleave(rows: DataFrame, total: int | None = None) -> DataFrame:
    """Frame-major order of (frame, channel); samples past the declared count are dropped."""
    rows = rows.where(F.col("frame") < total) if total is not None else rows
    return rows.orderBy("frame", "channel")


def deinterleave(flat: DataFrame, channels: int, position: str = "pos") -> DataFrame:
    """(channel, frame) of interleaved samples by their position."""
    return flat.withColumn("channel", F.pmod(position, F.lit(channels)).cast("int")).withColumn(
        "frame", F.floor(F.col(position) / channels).cast("bigint")
    )


def delivery_block(frame: Column, size: int = 1024) -> Column:
    """The block of at most ``size`` frames in which a frame is delivered."""
    return F.floor(frame / size).cast("bigint")


def hybrid_window(bin_: Column, n: int, left: int, right: int) -> Column:
    """A block's window with slopes of its neighbours' lengths: zeros outside, ones between."""
    lb, rb = n // 4 - left // 4, 3 * n // 4 - right // 4
    return (
        F.when(bin_ < lb, 0.0)
        .when(bin_ < lb + left // 2, N.half_window(bin_ - lb, left // 2))
        .when(bin_ < rb, 1.0)
        .when(bin_ < rb + right // 2, N.half_window(F.lit(rb + right // 2 - 1) - bin_, right // 2))
        .otherwise(0.0)
    )


def overlap_add(blocks: DataFrame, place: Column, value: str = "y", keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Samples on the timeline: the sum of the windowed blocks that reach a place."""
    return blocks.groupBy(*keys, place.alias("frame")).agg(F.sum(value).alias(value))


def regions(prime: DataFrame | None, tail: DataFrame | None, samples: DataFrame, stream: str = "stream") -> DataFrame:
    """``samples`` (stream, frame, sample) with what lies before and after them: ``prime`` (stream, k, sample) ends where the
    stream begins, ``tail`` begins where it ends."""
    out = samples.select(stream, "frame", "sample")
    if prime is not None:
        size = prime.groupBy(stream).agg((F.max("k") + 1).alias("_n"))
        rows = prime.join(small_side(size), stream)
        out = out.unionByName(rows.select(stream, (F.col("k") - F.col("_n")).cast("bigint").alias("frame"), "sample"))
    if tail is not None:
        size = samples.groupBy(stream).agg((F.max("frame") + 1).alias("_n"))
        rows = tail.join(small_side(size), stream)
        out = out.unionByName(rows.select(stream, (F.col("k") + F.col("_n")).cast("bigint").alias("frame"), "sample"))
    return out


def gather(plan: DataFrame, samples: DataFrame, stream: str = "stream", piece: int = 256) -> DataFrame:
    """stream, seq, s of each planned block (seq, sample_start, sample_end): its samples by place, 0 where there are none.

    Samples are met in pieces, so the join has a row a piece and not a sample.
    """
    pieces = samples.groupBy(stream, F.floor(F.col("frame") / piece).alias("piece")).agg(F.collect_list(F.struct("frame", "sample")).alias("s"))
    first, last = F.floor(F.col("sample_start") / piece), F.floor((F.col("sample_end") - 1) / piece)
    wanted = plan.select(stream, "seq", "sample_start", "sample_end", F.explode(F.sequence(first, last)).alias("piece"))
    met = wanted.join(pieces, [stream, "piece"], "left").groupBy(stream, "seq", "sample_start", "sample_end")
    got = met.agg(F.map_from_entries(F.flatten(F.collect_list(F.coalesce("s", F.array().cast(pieces.schema["s"].dataType))))).alias("m"))
    places = F.sequence(F.col("sample_start"), F.col("sample_end") - 1)
    return got.select(stream, "seq", F.transform(places, lambda at: F.coalesce(F.try_element_at("m", at), F.lit(0))).alias("s"))
