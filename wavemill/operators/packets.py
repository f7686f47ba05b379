"""Block packets of a parsed setup: floor heights, residues as cascades of codebook vectors, joint stereo, and whole packets.

Everything that is stored goes through one walk that writes or reads (``books.Bits``). Packets are independent, so
streams are packed and taken apart in Arrow batches, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavemill.operators import floors as residue_classes
from wavemill.operators import posts, setup as layout
from wavemill.operators.books import Bits, Book, width_of

STAGES = 8
#: A floor amplitude below this counts as none.
LEAST_FLOOR = 1e-8


# Floors ----------------------------------------------------------------------------------------


def best_choice(kind: dict, heights: list[int], books: list[Book]) -> int:
    """Which books the heights of a class take, as digits of ``bits`` bits, the first least.

    Each height scores 2 with a book that has it, 1 with one that has a neighbour at most two away, or where no book is
    needed as the height is 0; no book but another height rules a digit out. Digits are independent, so the
    best of each, the lowest on ties, make the best choice.
    """
    def score(height: int, book: int) -> int:
        if book < 0:
            return 1 if height == 0 else -1
        used = books[book].lengths
        there = lambda h: 0 <= h < len(used) and used[h] > 0
        return 2 if there(height) else int(any(there(height + d) for d in (-2, -1, 1, 2)))

    digits = [max(range(len(kind["books"])), key=lambda d, h=h: (score(h, kind["books"][d]), -d)) for h in heights]
    if any(score(h, kind["books"][d]) < 0 for h, d in zip(heights, digits)):
        return 0
    return sum(d << (kind["bits"] * j) for j, d in enumerate(digits))


def floor_body(io: Bits, floor: dict, books: list[Book], heights: list[int] | None = None) -> list[int]:
    """Stored heights of a floor (as of ``posts.wrap``): both ends plain, the others by class through codebooks."""
    bits = width_of(layout.RANGES[floor["multiplier"]] - 1)
    wanted = 2 + len(floor["inner"])
    if heights is not None and len(heights) != wanted:
        raise ValueError(f"a floor has {wanted} heights, not {len(heights)}")
    top = layout.RANGES[floor["multiplier"]] - 1
    out = [io.field(bits, None if heights is None else min(max(heights[k], 0), top)) for k in range(2)]
    for c in floor["classes"]:
        kind = floor["kinds"][c]
        own = None if heights is None else heights[len(out) : len(out) + kind["dim"]]
        choice = 0
        if kind["bits"]:
            master = books[kind["master"]]
            choice = best_choice(kind, own, books) if own else 0
            entry = master.code(io, None if io.reading else master.nearest_used(choice))
            choice = entry if io.reading else choice
        for j in range(kind["dim"]):
            book = kind["books"][choice & ((1 << kind["bits"]) - 1)]
            choice >>= kind["bits"]
            value = 0
            if book >= 0:
                value = books[book].code(io, None if io.reading else books[book].nearest_used(own[j]))
            out.append(value)
    if len(out) != wanted:
        raise ValueError(f"a floor has {wanted} heights, not {len(out)}")
    return out


def floor_levels(heights: list[int], used: list[bool], floor: dict, n: int) -> np.ndarray:
    """The floor's level 0..255 in each of ``n`` bins: integer lines between the posts that carry it."""
    x, y = np.array(layout.post_places(floor)), np.array(heights) * floor["multiplier"]
    order = np.argsort(x, kind="stable")
    order = order[np.array(used)[order]]
    x, y = x[order], y[order]
    at = np.arange(n)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 1)
    nxt = np.minimum(k + 1, len(x) - 1)
    rise, run = y[nxt] - y[k], np.maximum(x[nxt] - x[k], 1)
    return np.clip(y[k] + np.sign(rise) * (np.abs(rise) * (at - x[k]) // run), 0, 255)


def amplitude(levels: np.ndarray) -> np.ndarray:
    return 10.0 ** (7 * (levels - 255) / 256)


# Residues --------------------------------------------------------------------------------------


def class_of(part: np.ndarray, lanes: int, classes: int) -> np.ndarray:
    """The residue class of each partition (rows): by peak and mean, or for interleaved pairs by the peaks of first and others."""
    size = np.abs(part)
    if lanes == 1:
        peak, mean = size.max(axis=1), size.sum(axis=1) * 100 // part.shape[1]
        fits = [(peak <= p) & ((m < 0) | (mean < m)) for p, m in zip(residue_classes.MONO_PEAK, residue_classes.MONO_MEAN)]
    else:
        first = np.arange(part.shape[1]) % lanes == 0
        magnitude, angle = size[:, first].max(axis=1), size[:, ~first].max(axis=1)
        fits = [(magnitude <= m) & (angle <= a) for m, a in zip(residue_classes.PAIR_MAGNITUDE, residue_classes.PAIR_ANGLE)]
    if classes != len(fits) + 1:
        raise ValueError(f"no rule for {classes} residue classes")
    return np.where(np.any(fits, axis=0), np.argmax(fits, axis=0), classes - 1)


def silent(residue: dict) -> bool:
    """Whether a residue's first class takes no codebook, so that nothing but classes is stored of silence."""
    return all(b < 0 for b in residue["books"][0])


def _cascade(residue: dict, books: list[Book], parts: np.ndarray, classes: np.ndarray) -> list[dict[tuple[int, int], np.ndarray]]:
    """By stage: the entries that stand for each partition (lane, number), each stage taking the nearest to what is left."""
    left, out = parts.astype(np.float64), []
    for stage in range(STAGES):
        found: dict[tuple[int, int], np.ndarray] = {}
        for c, row in enumerate(residue["books"]):
            lane, at = np.nonzero(classes == c)
            if row[stage] < 0 or not len(lane):
                continue
            book = books[row[stage]]
            if not book.dim or residue["size"] % book.dim:
                raise ValueError("codebook does not divide a partition")
            points = left[lane, at].reshape(-1, book.dim)
            entries = book.nearest(points)
            left[lane, at] -= book.vectors[entries].reshape(len(lane), -1)
            found.update(zip(zip(lane.tolist(), at.tolist()), entries.reshape(len(lane), -1)))
        out.append(found)
    return out


def code_residue(
    io: Bits, residue: dict, books: list[Book], used: list[bool], n: int, rows: np.ndarray | None = None
) -> tuple[np.ndarray, bool]:
    """Residues of channels by bins, and whether the packet held them all. ``rows`` are integers to write.

    Class words of a group of partitions come before the first stage of the group; the other stages follow for all groups.
    Type 2 codes the channels as one row, bin by bin. A packet that ends early leaves what it held.
    """
    joint = residue["type"] == 2
    out = np.zeros((len(used), n))
    begin, size, words = residue["begin"], residue["size"], books[residue["classbook"]].dim
    count = (min(residue["end"], n * len(used) if joint else n) - begin) // size
    if count <= 0 or not any(used):
        return out, True
    lanes = [0] if joint else [j for j, u in enumerate(used) if u]
    flat = np.zeros((1, n * len(used))) if joint else np.zeros((len(lanes), n))
    n_classes = len(residue["books"])
    classes, cascade = np.zeros((len(lanes), count), np.int64), None
    if not io.reading:
        masked = np.where(np.array(used)[:, None], rows, 0)
        flat = masked.T.reshape(1, -1) if joint else masked[lanes]
        parts = flat[:, begin : begin + count * size].reshape(len(lanes), count, size)
        classes = class_of(parts.reshape(-1, size), len(used) if joint else 1, n_classes).reshape(len(lanes), count)
        cascade = _cascade(residue, books, parts, classes)

    def word(lane: int, first: int) -> None:
        own = [int(classes[lane, first + k]) if first + k < count else 0 for k in range(words)]
        entry = 0
        for c in own:  # the first is the highest digit
            entry = entry * n_classes + c
        entry = books[residue["classbook"]].code(io, None if io.reading else entry)
        for k in reversed(range(words)):
            entry, c = divmod(entry, n_classes)
            if io.reading and first + k < count:
                classes[lane, first + k] = c
        if entry:
            raise ValueError("residue class is out of range")

    def vectors(lane: int, part: int, stage: int) -> None:
        number = residue["books"][classes[lane, part]][stage]
        if number < 0:
            return
        book, at = books[number], begin + part * size
        if not io.reading:
            for entry in cascade[stage][lane, part]:
                book.write(io, int(entry))
            return
        for k in range(0, size, book.dim):
            flat[lane, at + k : at + k + book.dim] += book.vectors[book.read(io)]

    whole = True
    try:
        for stage in range(STAGES):
            for first in range(0, count, words):
                if stage == 0:
                    for lane in range(len(lanes)):
                        word(lane, first)
                for part in range(first, min(first + words, count)):
                    for lane in range(len(lanes)):
                        vectors(lane, part, stage)
    except EOFError:
        whole = False
    if joint:
        out = flat.reshape(n, len(used)).T.copy()
    else:
        out[lanes] = flat
    return out, whole


# Joint stereo ----------------------------------------------------------------------------------

#: Fixed by the method: how strongly a weaker, opposite channel counts against the stronger below and above a third of the bins.
REVERSAL_LOW, REVERSAL_HIGH, DAMPED = np.float32(0.18), np.float32(0.12), np.float32(0.94)
#: Fixed by the method: thresholds above a third of the bins under which a bin may be coded as one point, or left out of the check of phase.
POINT, REPHASE = np.float32(2.5), np.float32(0.5)


def signed_strength(first: np.ndarray, second: np.ndarray, reversal: np.ndarray) -> np.ndarray:
    """One signed strength for a pair: equal signs add up; else the stronger less its share of the weaker, with the stronger's sign."""
    a, b = np.abs(first * DAMPED), np.abs(second * DAMPED)
    together = ~((first > 0) & (second <= 0)) & ~((first <= 0) & (second >= 0))
    stronger, weaker = np.maximum(a, b).astype(np.float64), np.minimum(a, b).astype(np.float64)
    against = (stronger - weaker * reversal).astype(np.float32)
    sign = np.where(np.where(together | (a > b), first, second) > 0, 1, -1)
    return np.where(together, a + b, against) * sign.astype(np.float32)


def joint_stereo(spectra: np.ndarray, levels: np.ndarray, peaks: np.ndarray, used: list[bool]) -> np.ndarray:
    """Integer residues of a stereo block: a pair is kept as magnitude and angle, or merged into one point where that is not heard.

    Bins under the point threshold (which rises from 0 to ``POINT`` in the partition that holds a third of the bins, less the
    coupling peak) are merged, unless a partition's channels differ too much in size, on a mean over it and the one before, or
    a third of its strong bins are of opposite sign.
    """
    n = spectra.shape[1]
    size, third, last = (8 if n == 128 else 32), n // 3, n * 3 // 4
    last = min(n, -(-last // size) * size)
    x = spectra[:, :last].astype(np.float32)
    floor = amplitude(np.clip(levels[:, :last], 0, 255)).astype(np.float32)
    use = np.array(used)[:, None]
    ratio = np.where(use, x / floor, np.float32(0)).astype(np.float32)
    if not np.isfinite(ratio).all() or not np.isfinite(peaks).all():
        raise ValueError("a spectrum is not finite")
    out = np.zeros((2, n), np.int64)
    out[:, :last] = np.rint(ratio)
    bins = np.arange(last)
    into = (bins % size + 1).astype(np.float32) / size
    begin = bins // size * size
    rise = np.where(begin >= third, np.float32(1), np.where(third - begin <= size, into, np.float32(0)))
    threshold = np.maximum(POINT * rise - peaks[:, :last].astype(np.float32), 0)
    weight = np.abs(ratio)
    keep = (weight >= threshold) & use
    doubtful = ~keep & (weight >= REPHASE * rise) & use
    energy = np.where(use, np.sign(x) * x * x, 0).astype(np.float32)
    opposite = energy[0] * energy[1] < 0
    either = doubtful.any(axis=0)
    strong = ((ratio < -0.5) | (ratio >= 0.5)).any(axis=0)
    # Partition by partition only the smoothed difference is carried on.
    parts = last // size
    count = strong.reshape(parts, size).sum(axis=1)
    apart = np.where(strong, np.abs(np.abs(ratio[0]) - np.abs(ratio[1])), 0).reshape(parts, size).sum(axis=1)
    turned = (strong & opposite).reshape(parts, size).sum(axis=1)
    before, unlike = -1.0, np.zeros(parts, bool)
    for p in range(parts):
        if p * size >= n * 35 // 64:
            break
        now = apart[p] / count[p] if count[p] else -1.0
        unlike[p] = count[p] > 0 and ((now + before) / 2 if before > 0 else now) > 1.0
        before = now
    phased = (np.arange(parts) * size < n * 35 // 64) & (turned >= 0.34 * np.maximum(count, 1))
    lossless = keep.any(axis=0) | (either & np.repeat(unlike, size)) | (either & opposite & np.repeat(phased, size))
    wins = np.abs(out[0, :last]) > np.abs(out[1, :last])
    m = np.where(wins, out[0, :last], out[1, :last])
    a = np.where(m > 0, out[0, :last] - out[1, :last], out[1, :last] - out[0, :last])
    flip = np.where(a >= 2 * np.abs(m), -1, 1)
    reversal = np.where(bins < third, REVERSAL_LOW, REVERSAL_HIGH)
    strength = signed_strength(energy[0], energy[1], reversal)
    power = np.where(use, floor * floor, np.float32(1e-10)).sum(axis=0)
    point = np.sign(strength) * np.rint(np.sqrt(np.abs(strength) / power))
    out[0, :last] = np.where(lossless, m * flip, point)
    out[1, :last] = np.where(lossless, a * flip, 0)
    out[:, n * 3 // 4 // size * size + (size if n * 3 // 4 % size else 0) :] = 0
    return out


# Packets ---------------------------------------------------------------------------------------


def couple(rows: np.ndarray, coupling: list[tuple[int, int]]) -> np.ndarray:
    """Magnitude and angle of each pair, from which ``uncouple`` gets the pair back."""
    out = rows.copy()
    for m, a in coupling:
        first, second = out[m].copy(), out[a].copy()
        wins = np.abs(first) > np.abs(second)
        out[m] = np.where(wins, first, second)
        out[a] = np.where(out[m] > 0, first - second, second - first)
    return out


def uncouple(rows: np.ndarray, coupling: list[tuple[int, int]]) -> np.ndarray:
    out = rows.copy()
    for m, a in reversed(coupling):
        big, angle = out[m].copy(), out[a].copy()
        other = np.where(big > 0, big - np.abs(angle), big + np.abs(angle))
        out[m], out[a] = np.where(angle > 0, big, other), np.where(angle > 0, other, big)
    return out


def _mode(io: Bits, setup: dict, mode: int | None = None) -> int:
    """The header of a packet: its mode in as many bits as the setup's modes need."""
    mode = io.field(width_of(len(setup["modes"]) - 1), mode)
    if mode >= len(setup["modes"]):
        raise ValueError("packet names a mode that the setup does not have")
    return mode


def pack_block(
    setup: dict, books: list[Book], mode: int, heights: list[list[int] | None], spectra: np.ndarray, peaks: np.ndarray | None = None
) -> tuple[bytes, np.ndarray]:
    """A packet, and the residues in it, of a block: floor heights per channel (None: silent) and coefficients.

    With coupling ``peaks`` a stereo block goes through the joint quantizer.
    """
    io, channels, n = Bits(), len(spectra), spectra.shape[1]
    _mode(io, setup, mode)
    mapping = setup["mappings"][setup["modes"][mode]["mapping"]]
    levels = np.zeros((channels, n), np.int64)
    for c, own in enumerate(heights):
        floor = setup["floors"][mapping["floors"][layout.submap_of(mapping, c)]]
        io.field(1, int(own is not None))
        if own is not None:
            places, top = layout.post_places(floor), layout.RANGES[floor["multiplier"]]
            stored = posts.wrap(own, places, top)
            floor_body(io, floor, books, stored)
            levels[c] = floor_levels(*posts.unwrap(stored, places, top), floor, n)
    used = [h is not None for h in heights]
    if peaks is not None and channels == 2 and mapping["coupling"] == [(0, 1)]:
        rows = joint_stereo(spectra, levels, peaks, used)
    else:
        floor_of = amplitude(levels)
        ratio = np.where(floor_of < LEAST_FLOOR, 0, spectra / floor_of)
        rows = couple(np.rint(np.where(np.array(used)[:, None], ratio, 0)).astype(np.int64), mapping["coupling"])
    used = layout.propagate(used, mapping["coupling"])
    done = np.zeros_like(rows)
    for s, residue in enumerate(mapping["residues"]):
        own = [c for c in range(channels) if layout.submap_of(mapping, c) == s]
        if any(used[c] for c in own):
            code_residue(io, setup["residues"][residue], books, [used[c] for c in own], n, rows[own])
            done[own] = rows[own]
    return io.tobytes(), done


def parse_block(data: bytes, setup: dict, books: list[Book], channels: int, sizes: tuple[int, int]) -> dict:
    """A packet taken apart: mode, used, levels and residues of the channels, spectra, and whether the residues were whole."""
    io = Bits(data)
    try:
        mode = _mode(io, setup)
        mapping = setup["mappings"][setup["modes"][mode]["mapping"]]
        n = sizes[setup["modes"][mode]["long"]] // 2
        levels, used, heights = np.zeros((channels, n), np.int64), [], []
        for c in range(channels):
            floor = setup["floors"][mapping["floors"][layout.submap_of(mapping, c)]]
            used.append(bool(io.field(1)))
            heights.append(None)
            if used[-1]:
                y, carries = posts.unwrap(floor_body(io, floor, books), layout.post_places(floor), layout.RANGES[floor["multiplier"]])
                levels[c], heights[-1] = floor_levels(y, carries, floor, n), y
    except EOFError:
        raise ValueError("packet ends early") from None
    live = layout.propagate(used, mapping["coupling"])
    rows, whole = np.zeros((channels, n)), True
    for s, residue in enumerate(mapping["residues"]):
        own = [c for c in range(channels) if layout.submap_of(mapping, c) == s]
        if any(live[c] for c in own):
            rows[own], ok = code_residue(io, setup["residues"][residue], books, [live[c] for c in own], n)
            whole &= ok
    spectra = uncouple(rows, mapping["coupling"]) * np.where(np.array(used)[:, None], amplitude(levels), 0)
    return {"mode": mode, "used": used, "heights": heights, "levels": levels, "residues": rows, "spectra": spectra, "whole": whole}


def through_packets(rows: DataFrame, channels: int, block: int, mode: int = 0) -> DataFrame:
    """id, channel, heights, residues, back_heights, back, bytes of blocks (id, spectra, heights; arrays by channel) packed and parsed again.

    Uses the profile of our own for blocks of ``block`` samples.
    """
    setup, books = layout.profile(channels, block, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, spectra, heights in zip(*(batch[c].to_pylist() for c in ("id", "spectra", "heights"))):
                data, done = pack_block(setup, books, mode, heights, np.array(spectra, np.float64))
                got = parse_block(data, setup, books, channels, (block, block))
                back = got["residues"].astype(np.int64)
                out += [(key, c, heights[c], done[c].tolist(), got["heights"][c], back[c].tolist(), len(data)) for c in range(channels)]
            columns = list(zip(*out)) or [()] * 7
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), ints, longs, ints, longs, pa.int64())
            names = ["id", "channel", "heights", "residues", "back_heights", "back", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    shape = "id bigint, channel int, heights array<int>, residues array<bigint>, back_heights array<int>, back array<bigint>, bytes bigint"
    return rows.mapInArrow(run, shape)
