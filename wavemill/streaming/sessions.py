"""Sessions per stream whose output does not depend on how the input is cut into batches.

Decoding: packets in, finished samples out.
A block can be windowed only when the block after it is known, so each waits for the next packet;
samples before the middle of the newest windowed block are final and leave. State per
stream is one waiting packet and less than two blocks of samples. The row with ``eos`` ends a stream:
the last block is windowed as if a long one followed, and output stops at the declared count of frames. A
packet out of order, after the end, or one that ends early is an error and changes nothing.

Encoding: chunks of whole frames in, packets out. A block leaves as soon as the mode of the next one is certain, which
takes all samples that the choice looks at (``codec.reach``); so at most about that many frames are held, whatever the chunks. The row
with ``eos`` ends a stream and lets go the blocks that wait. The packets are those of the batch encoder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavemill.operators import container
from wavemill.operators.codec import (
    LEAST_FRAMES, LONG, QUANTUM, RISE, SIZES, following_mode, pack, reach, spectrum, unpack, windowed,
)

PACKETS = "stream bigint, seq bigint, payload binary, frames bigint, eos boolean"
OUT = "stream bigint, start bigint, channel int, samples array<double>"
STATE = "due bigint, done boolean, before int, waiting binary, base bigint, at bigint, held array<double>"


class Session:
    """The decoder of one stream; ``push`` and ``finish`` give (place, channels by samples) of what has become final."""

    def __init__(self, channels: int, steps: float, state: tuple | None = None) -> None:
        self.channels, self.steps = channels, steps
        self.due, self.done, self.before, self.waiting, self.base, self.at, held = state or (0, False, 0, None, 0, -LONG, [])
        self.held = np.asarray(held, np.float64).reshape(channels, -1)

    @property
    def state(self) -> tuple:
        return self.due, self.done, self.before, self.waiting, self.base, self.at, self.held.ravel().tolist()

    def push(self, seq: int, payload: bytes, frames: int) -> tuple[int, np.ndarray]:
        if self.done:
            raise ValueError("the stream has ended")
        if seq != self.due:
            raise ValueError(f"packet {seq} came where {self.due} was due")
        unpack(payload, self.channels, self.steps)  # refused before anything changes
        out = self._window(payload[0] & 1, frames) if self.waiting is not None else self._nothing()
        self.waiting, self.due = bytes(payload), self.due + 1
        return out

    def finish(self, frames: int) -> tuple[int, np.ndarray]:
        if self.done:
            raise ValueError("the stream has ended")
        out = self._window(1, frames, True) if self.waiting is not None else self._nothing()
        self.done, self.waiting = True, None
        return out

    def _nothing(self) -> tuple[int, np.ndarray]:
        return self.at, np.zeros((self.channels, 0))

    def _window(self, following: int, frames: int, last: bool = False) -> tuple[int, np.ndarray]:
        """Add the waiting block at its place and let go what no later block reaches."""
        mode, spectra = unpack(self.waiting, self.channels, self.steps)
        n = SIZES[mode]
        block = windowed(spectra, self.before, following)
        place = self.base - n // 2 - self.at
        if place < 0:  # a long block's window is zero up to the middle of a short one before it
            block, place = block[:, -place:], 0
        end = place + block.shape[1]
        size = max(self.held.shape[1], end)
        held = np.zeros((self.channels, size))
        held[:, : self.held.shape[1]] = self.held
        held[:, place:end] += block
        final = size if last else self.base - self.at
        start, out = self.at, held[:, :final]
        self.held, self.at = held[:, final:], self.at + final
        self.base += (n + SIZES[following]) // 4
        self.before = mode
        low, high = max(0, -start), max(0, min(out.shape[1], frames - start))
        return start + low, out[:, low : max(low, high)]


def decode_session(packets: DataFrame, channels: int, steps: float = 32.0) -> DataFrame:
    """stream, start, channel, samples of a stream of packets (``PACKETS``)."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, out = Session(channels, steps, state.get if state.exists else None), []
        rows = pd.concat(list(pdfs)).sort_values("seq")
        for seq, payload, frames, eos in zip(rows["seq"], rows["payload"], rows["frames"], rows["eos"]):
            parts = [session.push(int(seq), bytes(payload), int(frames))] if payload is not None else []
            parts += [session.finish(int(frames))] if eos else []
            out += [(key[0], at, c, x[c].tolist()) for at, x in parts for c in range(channels) if x.shape[1]]
        state.update(session.state)
        yield pd.DataFrame(out, columns=["stream", "start", "channel", "samples"])

    return packets.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


CHUNKS = "stream bigint, seq bigint, samples array<int>, eos boolean"
CODED = "stream bigint, seq bigint, mode int, payload binary, frames bigint"
ENCODING = "due bigint, done boolean, numbers array<bigint>, before array<double>, slots array<int>, held array<double>"


class Encoder:
    """The encoder of one stream; ``push`` and ``finish`` give the (seq, mode, payload) of blocks that are certain."""

    def __init__(self, channels: int, steps: float, least: int = LEAST_FRAMES, state: tuple | None = None) -> None:
        self.channels, self.steps, self.least = channels, steps, least
        self.due, self.done, numbers, before, slots, held = state or (0, False, [0] * 8, [], [], [])
        #: Frames so far, first held frame, first held slot; block number, its centre, modes before and of it, where its scan stopped.
        self.frames, self.base, self.first, self.seq, self.centre, self.previous, self.current, self.cursor = map(int, numbers)
        self.before = np.asarray(before, np.float64).reshape(channels, -1)
        self.slots, self.held = np.asarray(slots, np.int64), np.asarray(held, np.float64).reshape(channels, -1)

    @property
    def state(self) -> tuple:
        numbers = [self.frames, self.base, self.first, self.seq, self.centre, self.previous, self.current, self.cursor]
        return self.due, self.done, numbers, self.before.ravel().tolist(), self.slots.tolist(), self.held.ravel().tolist()

    def push(self, seq: int, samples: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Take interleaved 16-bit samples of whole frames."""
        if self.done:
            raise ValueError("the stream has ended")
        if seq != self.due:
            raise ValueError(f"chunk {seq} came where {self.due} was due")
        if len(samples) % self.channels:
            raise ValueError("a chunk holds whole frames")
        self.due += 1
        self.held = np.concatenate([self.held, np.asarray(samples, np.float64).reshape(-1, self.channels).T / 32768.0], axis=1)
        self.frames += len(samples) // self.channels
        out = []
        # Large chunks are worked off piece by piece, so that what is held stays as it was.
        while True:
            self._find_slots(self.frames // QUANTUM)
            if -(-reach(self.current, self.centre) // QUANTUM) * QUANTUM > self.frames:
                return out
            out.append(self._block())

    def finish(self) -> list[tuple[int, int, bytes]]:
        if self.done:
            raise ValueError("the stream has ended")
        if self.frames < self.least:
            raise ValueError(f"a stream has {self.frames} frames; {self.least} are needed")
        self.done, out = True, []
        self._find_slots(-(-self.frames // QUANTUM))
        while self.centre < self.frames:
            out.append(self._block())
        out.append(self._packet(1))
        self.held, self.slots = self.held[:, :0], self.slots[:0]
        return out

    def _find_slots(self, until: int) -> None:
        """Flag the quanta up to ``until`` in which the energy of some channel rises suddenly."""
        for q in range(self.first + len(self.slots), until):
            at = q * QUANTUM - self.base
            e = (self.held[:, at : at + QUANTUM] ** 2).sum(axis=1)
            rises = self.before.shape[1] > 0 and bool((e > RISE * self.before.mean(axis=1) + 1e-4).any())
            self.slots = np.append(self.slots, int(rises))
            self.before = np.concatenate([self.before, e[:, None]], axis=1)[:, -8:]

    def _block(self) -> tuple[int, int, bytes]:
        """The packet of the waiting block, now that the next one's mode is certain."""
        following, self.cursor = following_mode(self.slots, self.first, self.current, self.centre, self.cursor)
        out = self._packet(following)
        self.centre += (SIZES[self.current] + SIZES[following]) // 4
        self.previous, self.current, self.seq = self.current, following, self.seq + 1
        keep = max(self.base, min(self.centre - LONG // 2, (self.first + len(self.slots)) * QUANTUM))
        self.held, self.base = self.held[:, keep - self.base :], keep
        old = max(0, min(len(self.slots), max(self.cursor, self.centre) // QUANTUM - self.first))
        self.slots, self.first = self.slots[old:], self.first + old
        return out

    def _packet(self, following: int) -> tuple[int, int, bytes]:
        n = SIZES[self.current]
        start = self.centre - n // 2
        block = np.zeros((self.channels, n))
        low, high = max(start, self.base), min(start + n, self.base + self.held.shape[1])
        if high > low:
            block[:, low - start : high - start] = self.held[:, low - self.base : high - self.base]
        return self.seq, self.current, pack(spectrum(block, self.previous, following), self.current, self.steps)


def encode_session(chunks: DataFrame, channels: int, steps: float = 32.0, least: int = LEAST_FRAMES) -> DataFrame:
    """Packets (``CODED``) of a stream of chunks (``CHUNKS``); ``frames`` is known from the last ones on."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        encoder, out = Encoder(channels, steps, least, state.get if state.exists else None), []
        rows = pd.concat(list(pdfs)).sort_values("seq")
        for seq, samples, eos in zip(rows["seq"], rows["samples"], rows["eos"]):
            done = encoder.push(int(seq), np.asarray(samples if samples is not None else [], np.float64))
            out += [(key[0], *packet, None) for packet in done]
            if eos:
                out += [(key[0], *packet, encoder.frames) for packet in encoder.finish()]
        state.update(encoder.state)
        pdf = pd.DataFrame(out, columns=["stream", "seq", "mode", "payload", "frames"])
        yield pdf.astype({"frames": "Int64"})

    return chunks.groupBy("stream").applyInPandasWithState(run, CODED, ENCODING, "append", GroupStateTimeout.NoTimeout)


BYTES = "stream bigint, seq bigint, body binary, eos boolean"
TAKEN = "stream bigint, seq bigint, payload binary, header binary"
READING = "due bigint, done boolean, numbers array<bigint>, header binary, pending binary"


class Reader:
    """The packets of one container that comes in pieces; ``push`` gives those that are whole by now.

    Chunks before the data are held until the data begin; of the data only the packet that is not whole yet. The header is
    the ``fmt `` chunk. A piece that ends in the middle of anything waits for the next; at the end that is an error.
    """

    def __init__(self, state: tuple | None = None) -> None:
        self.due, self.done, numbers, self.header, pending = state or (0, False, [-1, 0, 0, 0], None, b"")
        #: Bytes of data left (-1: header not read yet), of the seek table left, packets so far, byte order.
        self.left, self.seek, self.count, self.big = map(int, numbers)
        self.pending = bytes(pending)

    @property
    def state(self) -> tuple:
        return self.due, self.done, [self.left, self.seek, self.count, self.big], self.header, self.pending

    def push(self, seq: int, body: bytes) -> list[tuple[int, bytes]]:
        if self.done:
            raise ValueError("the stream has ended")
        if seq != self.due:
            raise ValueError(f"piece {seq} came where {self.due} was due")
        self.due, self.pending = self.due + 1, self.pending + body
        if self.left < 0 and not self._read_header():
            return []
        skipped = min(self.seek, len(self.pending))
        at, self.seek, self.left = skipped, self.seek - skipped, self.left - skipped
        out = []
        while self.left and at + 2 <= len(self.pending):
            size = int.from_bytes(self.pending[at : at + 2], "big" if self.big else "little")
            if size + 2 > self.left:
                raise ValueError(f"packet of {size} bytes overruns")
            if at + 2 + size > len(self.pending):
                break
            out.append((self.count, self.pending[at + 2 : at + 2 + size]))
            at, self.left, self.count = at + 2 + size, self.left - 2 - size, self.count + 1
        self.pending = self.pending[at:] if self.left else b""
        return out

    def finish(self) -> None:
        if self.left:
            raise ValueError("container ends early")
        self.done = True

    def _read_header(self) -> bool:
        """Walk the chunks up to the data; whether they are all there."""
        raw = self.pending
        if len(raw) < 12:
            return False
        if raw[:4] not in (b"RIFF", b"RIFX") or raw[8:12] != b"WAVE":
            raise ValueError("not a container")
        self.big = int(raw[:4] == b"RIFX")
        at, header = 12, None
        while at + 8 <= len(raw):
            name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "big" if self.big else "little")
            if name == b"data":
                if header is None:
                    raise ValueError("header is missing")
                if len(header) != container.HEADER:
                    raise ValueError("header is malformed")
                offset = sum(n for _, n in container.FIELDS[: [f for f, _ in container.FIELDS].index("seek_size")])
                self.seek = int.from_bytes(header[offset : offset + 4], "little")
                if self.seek > size:
                    raise ValueError("seek table is larger than the data")
                self.header, self.left, self.pending = header, size, raw[at + 8 :]
                return True
            if at + 8 + size > len(raw):
                return False
            if name == b"fmt " and header is None:
                header = raw[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
        return False


def read_session(pieces: DataFrame) -> DataFrame:
    """Packets (``TAKEN``; the header comes with each) of containers that come in pieces (``BYTES``)."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader, out = Reader(state.get if state.exists else None), []
        rows = pd.concat(list(pdfs)).sort_values("seq")
        for seq, body, eos in zip(rows["seq"], rows["body"], rows["eos"]):
            out += [(key[0], n, payload, reader.header) for n, payload in reader.push(int(seq), bytes(body or b""))]
            if eos:
                reader.finish()
        state.update(reader.state)
        yield pd.DataFrame(out, columns=["stream", "seq", "payload", "header"])

    return pieces.groupBy("stream").applyInPandasWithState(run, TAKEN, READING, "append", GroupStateTimeout.NoTimeout)
