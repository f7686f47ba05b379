"""Streaming framing and overlap-add whose output doesn't depend on how the input is cut into batches.

State per stream is bounded: the framer holds less than a frame, the adder one block.
There is no end of a stream in Structured Streaming, so a row with ``eos`` set
flushes what is left. Out-of-order input is an error, never late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNKS = "stream bigint, seq bigint, samples array<double>, eos boolean"
FRAMES = "stream bigint, q bigint, samples array<double>"
PCM = "stream bigint, start bigint, samples array<double>"


def _ordered(pdfs: Iterator[pd.DataFrame], expected: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Chunks of a trigger by sequence number, which must go on from ``expected``."""
    rows = pd.concat(list(pdfs)).sort_values("seq")
    for seq, samples, eos in zip(rows["seq"], rows["samples"], rows["eos"]):
        if seq != expected:
            raise ValueError(f"chunk {seq} came where {expected} was due")
        expected += 1
        yield np.asarray(samples if samples is not None else [], np.float64), bool(eos)


def sliding_frames(chunks: DataFrame, width: int, hop: int) -> DataFrame:
    """Frames of ``width`` every ``hop`` samples of each stream of chunks."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, q, held = state.get if state.exists else (0, 0, [])
        held, out = np.asarray(held, np.float64), []
        for samples, _ in _ordered(pdfs, due):
            due += 1
            held = np.concatenate([held, samples])
            while len(held) >= width:
                out.append((key[0], q, held[:width].tolist()))
                held, q = held[hop:], q + 1
        state.update((due, q, held.tolist()))
        yield pd.DataFrame(out, columns=["stream", "q", "samples"])

    return chunks.groupBy("stream").applyInPandasWithState(
        run, FRAMES, "due bigint, q bigint, held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def overlap_add(blocks: DataFrame, hop: int) -> DataFrame:
    """Finished samples of windowed blocks (seq, samples) that begin ``hop`` apart; a last row with ``eos`` lets go the rest."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, at, held = state.get if state.exists else (0, 0, [])
        held, out = np.asarray(held, np.float64), []
        for samples, eos in _ordered(pdfs, due):
            due += 1
            if len(samples):
                size = max(len(held), len(samples))
                held = np.pad(held, (0, size - len(held))) + np.pad(samples, (0, size - len(samples)))
                out.append((key[0], at, held[:hop].tolist()))
                held, at = held[hop:], at + hop
            if eos and len(held):
                out.append((key[0], at, held.tolist()))
                held, at = held[:0], at + len(held)
        state.update((due, at, held.tolist()))
        yield pd.DataFrame(out, columns=["stream", "start", "samples"])

    return blocks.groupBy("stream").applyInPandasWithState(
        run, PCM, "due bigint, at bigint, held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming result over what is there now and read what it wrote."""
    spark, schema = result.sparkSession, result.schema
    query = result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start(path)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(schema).parquet(path)
