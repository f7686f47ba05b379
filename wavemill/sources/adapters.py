"""Ordered signal views of general tables, each in a total order of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import numeric as N
from wavemill.plans.runtime import table


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, frame, sample (16 bits), event_id, user_id: events in order, dealt to two channels in turn."""
    x = (F.col("value") - 50.0) / 512.0
    return table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(2)).cast("int").alias("channel"),
        F.floor(F.col("event_id") / 2).cast("bigint").alias("frame"),
        N.to_int16(x).alias("sample"),
        "event_id",
        "user_id",
    )


def user_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream (user), i (event), sample: a short signal per user."""
    return pcm(spark, sf_dir).select(F.col("user_id").alias("stream"), F.col("event_id").alias("i"), "sample")


def spectrum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, stream (label), x: one array of 64 coefficients a row."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("label").alias("stream"), F.col("embedding").cast("array<double>").alias("x")
    )


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, stream, bin, coeff."""
    return spectrum_rows(spark, sf_dir).select("idx", "stream", F.posexplode("x").alias("bin", "coeff"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream (conversation), seq (turn), mode (1: long), size (bytes), payload."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream"),
        F.col("turn").alias("seq"),
        (F.col("role") == "assistant").cast("int").alias("mode"),
        F.octet_length(body).cast("bigint").alias("size"),
        F.encode(body, "UTF-8").alias("payload"),
    )


def buffer(spark: SparkSession, data, channels: int, form: str = "rows", path: str = "buffer", rate: int = 48000) -> DataFrame:
    """Blocks of samples, as of ``wav.read_wav``, of a buffer in memory.

    ``form`` is ``rows`` (a list of samples of each channel), ``channel-major`` (16-bit little-endian bytes, channel after channel) or
    ``interleaved`` (the same, frame after frame). Samples are 16-bit integers or numbers of -1..1 that stand for one exactly; uneven
    channels, part frames, no frames and any other number are refused.
    """
    from wavemill.sources import wav

    if channels < 1 or rate < 1:
        raise ValueError("channels and rate are positive")
    if form == "rows":
        if len(data) != channels or len({len(r) for r in data}) != 1:
            raise ValueError("a row of the same length for each channel is needed")
        x = np.array(data, np.float64).T
        if np.issubdtype(np.asarray(data[0]).dtype, np.floating):
            x = x * 32768.0
        if not (np.isfinite(x).all() and (x == np.floor(x)).all() and (np.abs(x + 0.5) <= 32767.5).all()):
            raise ValueError("a sample is no 16-bit number")
        frames = x.astype(np.int16)
    elif form in ("channel-major", "interleaved"):
        if len(data) % (2 * channels):
            raise ValueError("data is not whole frames")
        flat = np.frombuffer(data, "<i2")
        frames = flat.reshape(channels, -1).T if form == "channel-major" else flat.reshape(-1, channels)
    else:
        raise ValueError(f"no such form: {form}")
    if not len(frames):
        raise ValueError("there are no frames")
    rows = [(*r[:5], r[5].tolist(), r[6]) for r in wav._blocks(path, frames, rate)]
    return spark.createDataFrame(rows, wav.BLOCKS)
