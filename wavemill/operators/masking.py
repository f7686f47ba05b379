"""Masking: log curves, smoothing over critical bands, tone seeds, floor envelopes and their memory between blocks.

Curves are rows of an array, so a batch of blocks is worked on at once in numpy; what a block needs of the one before is a
``lag`` where it is just that block's curve, and a scan over the blocks of one stream and channel where it is a running state.
Geometry follows from the number of bins and the rate by public formulas; nothing is a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from wavemill.operators import spectral

NOTHING = -9999.0
#: Fixed by the method: added to levels so that the mean error of the bit logarithm vanishes.
LOG_ADD = 0.345


# Geometry --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Geometry:
    """What follows from the number of bins and the sample rate."""

    bins: int
    rate: int
    low: np.ndarray  # first bin, less one, of the window around each bin; below zero it is mirrored
    high: np.ndarray  # its last bin; past the end no window is fitted any more
    octave: np.ndarray  # octave line of each bin
    threshold: np.ndarray  # of hearing, in dB
    widths: np.ndarray  # how many bins a bin's peak holds on after it
    lines: int  # octave lines in all
    eighth: int  # octave lines an eighth of an octave has


def bark(hz: np.ndarray) -> np.ndarray:
    """Critical-band rate (Traunmüller's and Zwicker's arctangents), odd in frequency."""
    return 13.1 * np.arctan(0.00074 * hz) + 2.24 * np.arctan(hz * np.abs(hz) * 1.85e-8) + 1e-4 * hz


def threshold_of_hearing(hz: np.ndarray) -> np.ndarray:
    """Terhardt's threshold in quiet, in dB, less 100 so that full scale is near 0."""
    k = np.maximum(hz, 20.0) / 1000
    return 3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * np.minimum(k, 18.0) ** 4 - 100


def octave_lines(bins: int, rate: int, shift: int = 4) -> np.ndarray:
    """The octave line of each bin's centre, ``2 ** (shift + 1)`` lines an octave, from 62.5 Hz."""
    hz = (np.arange(bins) + 0.25) * 0.5 * rate / bins
    return ((np.log2(hz) - 5.965784) * (2 << shift) + 0.5).astype(np.int64)


def geometry(bins: int, rate: int, least: int = 4, shift: int = 4) -> Geometry:
    """Half a critical band to either side of each bin, but ``least`` bins at least."""
    at = np.arange(bins)
    hz = rate / (2 * bins)
    z = bark(np.arange(-99, 2 * bins) * hz)
    low = np.minimum(np.searchsorted(z, bark(at * hz) - 0.5) - 99, at - least) - 1
    high = np.maximum(np.searchsorted(z, bark(at * hz) + 0.5) - 99, at + least) - 1
    octave = octave_lines(bins, rate, shift)
    first = int(octave.min())
    eighth = max(1, (2 << shift) // 8)
    hold = np.maximum(1, (high - at) // 2 + 1)
    return Geometry(bins, rate, np.maximum(low, -bins + 1), high, octave - first, threshold_of_hearing(at * hz), hold, int(octave.max()) - first + eighth + 1, eighth)


def tone_offsets(level: float, eighths: np.ndarray) -> np.ndarray:
    """How far below a tone of ``level`` dB its masking lies, by distance in eighths of an octave: steep below it, flatter above the louder it is."""
    return np.where(eighths < 0, 6.0 * eighths, -eighths * np.clip(6.0 - 0.05 * level, 1.0, 6.0)) - 6.0


# Curves ----------------------------------------------------------------------------------------


def bit_log(x: np.ndarray) -> np.ndarray:
    """Decibels read off the bits of single-precision numbers."""
    # 20 log10(2) / 2^23 and 127 * 20 log10(2), in single precision.
    bits = np.abs(np.asarray(x, np.float32)).view(np.uint32)
    return bits.astype(np.float64) * 7.1771142984e-7 - 764.6162109375


def spectrum_log(coefficients: np.ndarray) -> np.ndarray:
    """The log curve of lapped-transform coefficients."""
    return bit_log(coefficients) + LOG_ADD


def power_log(samples: np.ndarray) -> np.ndarray:
    """The log curve of the Fourier power of blocks of n samples, n / 2 bins, scaled by 4 / n."""
    n = samples.shape[-1]
    spectrum = np.fft.rfft(samples.astype(np.float32), axis=-1)[..., : n // 2]
    level = np.where(np.arange(n // 2) == 0, bit_log(spectrum.real), 0.5 * bit_log(np.abs(spectrum) ** 2))
    return level + bit_log(np.array(4.0 / n)) + 2 * LOG_ADD


def smooth(curves: np.ndarray, low: np.ndarray, high: np.ndarray, offset: float, fixed: int = 0) -> np.ndarray:
    """A weighted least-squares line over each bin's window, taken at the bin.

    A level counts with its squared height over -``offset`` (1 at least), the first bin half. Windows that begin below zero are
    mirrored; past the last whole window its line goes on. With ``fixed``, the line over a window of that many bins is taken
    where it lies lower.
    """
    n = curves.shape[-1]
    x = np.arange(n, dtype=np.float64)
    y = np.maximum(curves + offset, 1.0)
    w = y * y * np.where(x == 0, 0.5, 1.0)
    # The mean of the first bin's place is kept off zero.
    sums = [np.cumsum(v, axis=-1) for v in (w, w * np.maximum(x, x == 0), w * x * x, w * y, w * x * y)]

    def lines(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        whole = int(np.argmax(end >= n)) if (end >= n).any() else n
        if not whole:
            return np.zeros(curves.shape)
        a, b = start[:whole], end[:whole]
        mirrored = np.where(a < 0, 1.0, -1.0)
        a = np.abs(a)
        even = lambda s: s[..., b] + mirrored * s[..., a]
        odd = lambda s: s[..., b] - s[..., a]
        s0, s1, s2, t0, t1 = even(sums[0]), odd(sums[1]), even(sums[2]), even(sums[3]), odd(sums[4])
        wide = s0 * s2 - s1 * s1
        wide = np.where(np.abs(wide) < 1e-20, 1.0, wide)
        slope, begin = (s0 * t1 - s1 * t0) / wide, (s2 * t0 - s1 * t1) / wide
        place = np.minimum(np.arange(n), whole - 1)
        return begin[..., place] + slope[..., place] * x

    out = np.maximum(lines(low, high), 0.0) - offset
    if fixed > 0:
        end = np.arange(n) + fixed // 2
        out = np.minimum(out, lines(end - fixed, end) - offset)
    return out


def lifted(base: np.ndarray, choice: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``base`` raised by the offset that each bin's noisiness chooses."""
    return base + offsets[np.clip((choice + 0.5).astype(np.int64), 0, len(offsets) - 1)]


def suppress_short(original: np.ndarray, base: np.ndarray, caps: np.ndarray, limit: int) -> np.ndarray:
    """``base`` lowered around narrow peaks of one curve: by how far a peak rises over its feet, less a threshold where
    the base is under it, and no more than ``caps``."""
    n = len(original)
    limit, need = min(limit, n), 9.0 if n != 256 else 15.0
    damped = np.where(original >= -70, original, (original + 70) * 0.1 - 70)
    damped[min(limit + 4, n) :] = 0
    drop = np.zeros(n)
    at = 4
    while at < min(limit, n - 1):
        if not (original[at - 1] < original[at] > original[at + 1]):
            at += 1
            continue
        # Feet: as far as the curve keeps falling, three bins to either side at most.
        left = at - 1
        while left - 1 >= at - 2 and original[left - 1] <= original[left]:
            left -= 1
        right = at + 1
        while right + 1 < min(at + 4, n) and original[right + 1] <= original[right]:
            right += 1
        rise = damped[at] - min(damped[left], damped[right])
        if rise > need:
            rise = (rise - need) * 0.6 if base[at] < original[at] else rise
            drop[left : right + 1] = np.maximum(drop[left : right + 1], rise)
        at = right + 1
    out = base.copy()
    out[3:limit] -= np.minimum(drop, caps)[3:limit]
    return out


def suppress_long(base: np.ndarray, caps: np.ndarray, active: int, group: int = 8) -> np.ndarray:
    """``base`` (rows) lowered around broad peaks: where a mean over ``group`` bins stands over both neighbours by more than 2."""
    mean = base[..., :active].reshape(*base.shape[:-1], -1, group).mean(axis=-1)
    out = base.copy()
    for g in range(3, mean.shape[-1] - 1):
        foot = np.minimum(mean[..., g - 1], mean[..., g - 2])
        peak = (mean[..., g] > mean[..., g - 1]) & (mean[..., g] > mean[..., g + 1]) & (mean[..., g] - foot > 2)
        drop = np.where(peak, np.minimum(mean[..., g] - foot - 2, caps[g * group]), 0.0)
        near = mean[..., g - 2] >= mean[..., g - 1]  # the foot lies next to the peak
        end = min(base.shape[-1], (g + 3) * group + 1)
        out[..., (g - 2) * group : end] -= np.where(near, drop, 0.0)[..., None]
        out[..., (g - 3) * group : end] -= np.where(near, 0.0, drop)[..., None]
    return out


def noise_curves(original: np.ndarray, g: Geometry, offsets: np.ndarray, fixed: int, suppress=None) -> dict[str, np.ndarray]:
    """first, residual, choice, base and remap of log curves (rows): the noise floor, and how noisy each bin is over it."""
    first = smooth(original, g.low, g.high, 140.0)
    residual = original - first
    choice = smooth(residual, g.low, g.high, 0.0, fixed)
    base = original - residual
    base = suppress(base) if suppress else base
    return {"first": first, "residual": residual, "choice": choice, "base": base, "remap": lifted(base, choice, offsets)}


def coupling_peak(raw: Column, previous: Column, base: Column, offset: Column, rise: float = 12.0) -> Column:
    """How far a bin has risen since the block before, where it stands clear of the noise; else 0."""
    step = raw - previous
    return F.when((raw - (base + offset) >= rise) & (step >= 1.0), step).otherwise(0.0)


# Tone seeds ------------------------------------------------------------------------------------


def chase(seeds: np.ndarray, lines: int) -> np.ndarray:
    """Each seed holds on for ``lines`` octave lines after it, unless a greater one comes: a sliding maximum."""
    out, reach = seeds, 0
    while reach < lines:  # by doubling
        step = min(reach + 1, lines - reach)
        moved = np.concatenate([np.full((*out.shape[:-1], step), NOTHING), out[..., :-step]], axis=-1)
        out, reach = np.maximum(out, moved), reach + step
    return out


def tone_seeds(levels: np.ndarray, floor: np.ndarray, g: Geometry, reference: float) -> np.ndarray:
    """By octave line, the masking of the strongest bin of each line that comes near the floor (rows)."""
    first = np.flatnonzero(np.r_[True, g.octave[1:] != g.octave[:-1]])
    line = g.octave[first]
    peak = np.maximum.reduceat(levels, first, axis=-1)
    last = np.append(first[1:], g.bins) - 1
    peak = np.where(peak + 6.0 > floor[..., last], peak, NOTHING)
    seeds = np.full((*levels.shape[:-1], g.lines), NOTHING)
    away = np.arange(-8, 25)
    # The masking's shape depends on the level in steps of 10 dB over 30.
    step = np.clip((peak - reference + 100 - 30) // 10, 0, 7)
    for k in range(8):
        loud = np.where(step == k, peak, NOTHING)
        for e, down in zip(away, tone_offsets(30.0 + 10 * k, away)):
            to = line + e * g.eighth
            ok = (to > 0) & (to < g.lines)
            lifted_ = np.where(loud[..., ok] > NOTHING, loud[..., ok] + down, NOTHING)
            # Lines of bins differ, so each target is met once.
            seeds[..., to[ok]] = np.maximum(seeds[..., to[ok]], lifted_)
    return seeds


def seed_floor(seeds: np.ndarray, floor: np.ndarray, g: Geometry, ceiling: float) -> np.ndarray:
    """The floor raised to the least seed between a bin's neighbours on the octave scale, at most ``ceiling``; lines without a seed don't count."""
    held = chase(seeds, g.eighth)
    open_ = np.where(held > NOTHING, held, np.inf)
    out, at, pos = floor.copy(), 0, max(0, int(g.octave[0]) - g.eighth // 2)
    while at < g.bins:
        after = min(at + 1, g.bins - 1)
        end = max(pos, min(g.lines - 1, int(g.octave[at] + g.octave[after]) >> 1))
        least = np.minimum(open_[..., pos : end + 1].min(axis=-1), ceiling)
        least = np.where(np.isfinite(open_[..., pos : end + 1]).any(axis=-1), least, NOTHING)
        upto = max(at + 1, int(np.searchsorted(g.octave, end, side="right"))) if at + 1 < g.bins else g.bins
        out[..., at:upto] = np.maximum(out[..., at:upto], least[..., None])
        at, pos = upto, end
    return out


def tone_floor(levels: np.ndarray, peaks: np.ndarray, top: np.ndarray, g: Geometry, shift: float = -40.0, least: float = -140.0, ceiling: float = 0.0) -> np.ndarray:
    """The masking of tones over the threshold of hearing, which is set by each channel's peak (rows); ``top`` is the running peak."""
    floor = g.threshold + np.maximum(peaks + shift, least)[..., None]
    seeds = np.stack([tone_seeds(row, f, g, t) for row, f, t in zip(levels, floor, top)])
    return seed_floor(seeds, floor, g, ceiling)


# Envelopes -------------------------------------------------------------------------------------

#: Fixed by the method: the level difference at which the side gain turns, and its slopes under and over it.
TURN, UNDER, OVER = 17.2, 0.0003, 0.005


def side_factor(difference: Column, gain: float) -> Column:
    """What a coefficient is scaled by, given how far its noise floor lies over its level."""
    away = difference + TURN
    over = 1.0 - away * OVER * gain
    return F.when(difference <= -TURN, 1.0 - away * UNDER * gain).otherwise(F.when(over < 0, 0.0001).otherwise(over))


def floor_choice(
    tone: Column, noise: Column, mask: Column, source: Column, place: Column, bias: float, cap: float, q: float, stop: int, end: int, weight: float
) -> Column:
    """The floor of a bin: the noise floor under a cap, or the tone floor where it is higher, which between ``stop`` and
    ``end`` yields to a source that lies lower."""
    low = F.least(noise + mask, F.lit(cap))
    down = q * (bias - 25.0) if q >= 0 and bias >= 25 else 0.0
    target = tone + bias - F.when(place <= stop, down).otherwise(0.0)
    inside = (place > stop) & (place < end) & (source < target)
    yielded = F.when(source >= low, source).otherwise(target - (target - low) * weight)
    return F.when(low <= target, F.when(inside, yielded).otherwise(target)).otherwise(low)


@dataclass(frozen=True)
class Envelope:
    """Parameters of a floor envelope."""

    mask: np.ndarray
    bias: float = 6.0
    cap: float = 0.0
    stop: int = 0
    end: int = 1 << 30
    weight: float = 0.5
    gain: float = 1.0
    bands: tuple[int, int, int] = (24, 12, 4)
    span: int = 8


def _side(difference: np.ndarray, gain: float) -> np.ndarray:
    away = difference + TURN
    over = 1.0 - away * OVER * gain
    return np.where(difference <= -TURN, 1.0 - away * UNDER * gain, np.where(over < 0, 0.0001, over))


def _chosen(value: np.ndarray, target: np.ndarray, source: np.ndarray, p: Envelope) -> np.ndarray:
    place = np.arange(target.shape[-1])
    inside = (place > p.stop) & (place < p.end) & (source < target)
    yielded = np.where(source >= value, source, target - (target - value) * p.weight)
    return np.where(value <= target, np.where(inside, yielded, target), value)


def long_envelope(tone: np.ndarray, noise: np.ndarray, raw: np.ndarray, side: np.ndarray, p: Envelope) -> tuple[np.ndarray, np.ndarray]:
    """Floor and scaled coefficients of long blocks (rows); they keep no state but the curve of the block before."""
    value = np.minimum(noise + p.mask, p.cap)
    return _chosen(value, tone + p.bias, raw, p), side * _side(value - raw, p.gain)


def temporal_kernel(run: Column, tail: Column, code: Column, previous: Column, bias: float, hold: bool = False) -> Column:
    """active, lower, rebase, chase: how much a short block's peaks lean on the blocks before it.

    Only the plain short code is active. Right after another code peaks lean most; in a run of eight or more blocks least.
    """
    multiplier = 3 if bias >= 3 else 2
    lower = F.when(previous != 0, 0.7).when(run >= 8, 0.3).otherwise(0.7 - (run - 1) / 17.0)
    lower = lower * F.when(tail != 0, tail / 8.0).otherwise(1.0) * (0.2 if hold else 1.0)
    rebase = F.when(previous != 0, 0.0).when(run >= 8, 25.0).otherwise((run * multiplier).cast("double"))
    run_on = F.when(previous != 0, 8.0).when(run >= 8, 0.0).otherwise((8 - run).cast("double"))
    active = code == 0
    parts = {"lower": lower, "rebase": rebase, "chase": run_on}
    return F.struct(active.cast("int").alias("active"), *(F.when(active, v).otherwise(0.0).alias(n) for n, v in parts.items()))


def kernel_of(run: int, tail: int, code: int, previous: int, bias: float) -> tuple[bool, float, float, float]:
    """``temporal_kernel`` of one block."""
    if code:
        return False, 0.0, 0.0, 0.0
    if previous:
        lower, rebase, run_on = 0.7, 0.0, 8.0
    elif run >= 8:
        lower, rebase, run_on = 0.3, 25.0, 0.0
    else:
        lower, rebase, run_on = 0.7 - (run - 1) / 17, float(run * (3 if bias >= 3 else 2)), float(8 - run)
    return True, lower * (tail / 8 if tail else 1.0), rebase, run_on


def relax(history: np.ndarray, raw: np.ndarray, widths: np.ndarray, step: float = 5.0, fall: float = 75.0) -> np.ndarray:
    """A history raised where the slopes after the bins of a new curve stand over it.

    Bins are taken in order, and each raises what the ones before have left, by ``step`` over a place's own width.
    """
    out, n = history.astype(np.float64).copy(), len(history)
    for k in np.flatnonzero(widths > 1):
        at = np.arange(k + 1, min(n, k + int(widths[k])))
        over = raw[k] - (at - k) * fall / widths[k] > out[at]
        out[at[over]] += step / widths[at[over]]
    return out


def short_envelope(
    tone: np.ndarray, noise: np.ndarray, raw: np.ndarray, side: np.ndarray, state: np.ndarray, history: np.ndarray,
    kernel: tuple[bool, float, float, float], tail: int, previous: int, p: Envelope, widths: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Floor, scaled coefficients, history and group flags of one short block of one channel.

    A bin that rises over its history, where neither tone nor state reach the noise floor, is a peak: its floor comes down
    from the noise towards the tone, less near the bottom, and not under the state.
    """
    active, lower, rebase, run_on = kernel
    place = np.arange(len(raw))
    if active:
        history = relax((state if previous else history) - 5.0, raw, widths)
    low = np.minimum(p.mask + noise, p.cap)
    target = tone + p.bias
    peak = active & (target < low) & (state < low) & (history + rebase < raw)
    history = np.where(peak, raw, history)
    strong = peak & (tail == 0) & (place < p.end) & (low - state > 20) & (raw - state > 25)
    near = strong & (target > -100) & (raw - target < 48)
    pull = np.where(raw - state >= 35, run_on, (35 - (raw - state)) * 0.1 * run_on)
    target = np.where(near, np.maximum(np.maximum(target - pull, -100), raw - 48), target)
    first, second, third = p.bands
    share = lower * np.where(place > second, 1.0, np.where(place > third, 0.5, 0.3))
    share = np.where(state >= raw, 0.0, share)
    width = np.where(place > first, 30.0, np.where(place > second, 20.0, 10.0))
    gap = low - target
    gap = np.where(gap > width, width + (gap - width) * 0.1, gap)
    value = np.maximum(low - gap * share, state)
    apart = value - np.maximum(state, -140)
    value = np.where(strong & (apart > 20), value - (apart - 20) * 0.2, value)
    value = np.where(peak, value, low)
    groups = np.zeros(-(-len(raw) // p.span))
    groups[np.unique(place[strong] // p.span)] = -1
    return _chosen(value, target, raw, p), side * _side(value - raw, p.gain), history, groups


# Transients ------------------------------------------------------------------------------------


def transient_mask(spectra: np.ndarray, mean: np.ndarray, bias: float = -85.0, fall: float = 8.0) -> np.ndarray:
    """Half as many levels as bins (rows): the power of neighbouring bins, over a floor that falls from a level set by the mean energy."""
    pairs = spectra.reshape(*spectra.shape[:-1], -1, 2)
    level = 0.5 * bit_log((pairs**2).sum(axis=-1))
    begin = 0.5 * bit_log(np.abs(mean)) - 15.0
    slope = begin[..., None] - fall * np.arange(level.shape[-1])
    return np.maximum(np.maximum(slope, level), bias)


def band_flags(bands: DataFrame, window: int, up: list[float], down: list[float], carry: Column, stream: str = "stream", at: str = "i") -> DataFrame:
    """``flags`` of each quantum from its band levels (an array): 5 where some band rises out of its history, 2 where one falls out of it.

    A band's newer two values are held against the extremes of the ``window`` values before them.
    """
    w = W.partitionBy(stream).orderBy(at)
    each = bands.select(stream, at, carry.alias("_c"), F.posexplode("bands").alias("band", "v"))
    own = W.partitionBy(stream, "band").orderBy(at)
    before = own.rowsBetween(-window - 1, -2)
    last = F.coalesce(F.lag("v").over(own), F.col("v"))
    each = each.select(
        stream, at, "band", "_c",
        (F.greatest("v", last) - F.max("v").over(before)).alias("rise"), (F.least("v", last) - F.min("v").over(before)).alias("fall"),
    )
    limit = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("band") + 1)
    bits = F.when(F.col("rise") > limit(up) + F.col("_c"), 5).otherwise(0).bitwiseOR(F.when(F.col("fall") < limit(down) - F.col("_c"), 2).otherwise(0))
    del w
    return each.groupBy(stream, at).agg(F.bit_or(bits).alias("flags"))


# Blocks ----------------------------------------------------------------------------------------


def analyse_long(blocks: DataFrame, rate: int, n: int, offsets: list[float], channels: int = 2) -> DataFrame:
    """stream, channel, seq, floor, side, peak of long blocks (stream, channel, seq, samples windowed).

    A block needs only the log curve of the one before, which is a lag; the running peak is one window over a row a block.
    """
    g, bins = geometry(n // 2, rate), n // 2
    lut = np.array(offsets)

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch["samples"].to_pylist()).astype(np.float64) if len(batch) else np.zeros((0, n))
            c = spectral.lapped(x) * (4.0 / n)
            out = [_list(c), _list(spectrum_log(c)), _list(power_log(x))]
            top = np.minimum(power_log(x).max(axis=-1), 0.0) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *out, pa.array(top)], [*keys, "coefficients", "raw", "power", "own"])

    keys = ("stream", "channel", "seq")
    kinds = "coefficients array<double>, raw array<double>, power array<double>, own double"
    rows = blocks.select(*keys, "samples").mapInArrow(curves, f"stream bigint, channel int, seq bigint, {kinds}")
    by = W.partitionBy("stream", "channel").orderBy("seq")
    decay = 140.0 * bins / rate
    tops = rows.groupBy("stream", "seq").agg(F.max("own").alias("top"))
    rise = F.max(F.col("top") + F.col("seq") * decay).over(W.partitionBy("stream").orderBy("seq"))
    tops = tops.select("stream", "seq", (rise - F.col("seq") * decay).alias("top"))
    rows = rows.withColumn("before", F.coalesce(F.lag("raw").over(by), F.array_repeat(F.lit(0.0), bins))).join(tops, ["stream", "seq"])

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, raw, power, before = (np.stack(batch[k].to_pylist()) if len(batch) else np.zeros((0, bins)) for k in ("coefficients", "raw", "power", "before"))
            own, top = batch["own"].to_numpy(), batch["top"].to_numpy()
            noise = noise_curves(raw, g, lut, 100, lambda b: suppress_long(b, np.full(bins, 20.0), bins))
            tone = tone_floor(power, own, top, g) if len(raw) else raw
            floor, side = long_envelope(tone, noise["remap"], raw, c, Envelope(np.zeros(bins)))
            step = raw - before
            peak = np.where((raw - noise["remap"] >= 12) & (step >= 1) & (channels == 2), step, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *map(_list, (floor, side, peak))], [*keys, "floor", "side", "peak"])

    return rows.mapInArrow(shaped, "stream bigint, channel int, seq bigint, floor array<double>, side array<double>, peak array<double>")


def analyse_short(blocks: DataFrame, rate: int, n: int, offsets: list[float]) -> DataFrame:
    """stream, channel, seq, floor, side of short blocks (stream, channel, seq, code, samples windowed).

    State and history are scanned along the blocks of one stream and channel; both are one curve, and a group is the
    short blocks of one channel.
    """
    g, bins = geometry(n // 2, rate), n // 2
    lut, p = np.array(offsets), Envelope(np.zeros(n // 2))

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        x = np.stack(table["samples"].to_pylist()).astype(np.float64)
        c = spectral.lapped(x) * (4.0 / n)
        raw, power = spectrum_log(c), power_log(x)
        top = np.minimum(power.max(axis=-1), 0.0)
        tone = tone_floor(power, top, np.maximum.accumulate(top), g)
        state, history, previous, run, tail = np.zeros(bins), np.zeros(bins), 0, 0, 0
        floors, sides = [], []
        for i, code in enumerate(table["code"].to_pylist()):
            noise = noise_curves(raw[i : i + 1], g, lut, 0)
            base = suppress_short(raw[i], noise["base"][0], np.full(bins, 20.0), bins)
            remap = lifted(base, noise["choice"][0], lut)
            kernel = kernel_of(max(run, 1), tail, code, previous, p.bias)
            floor, side, history, _ = short_envelope(tone[i], remap, raw[i], c[i], state, history, kernel, tail, previous, p, g.widths)
            floors.append(floor)
            sides.append(side)
            state = raw[i]
            run, tail, previous = (run + 1 if code == previous else 1), _tail(tail, code, previous), code
        keep = [table[k] for k in ("stream", "channel", "seq")]
        return pa.table([*keep, _list(np.stack(floors)), _list(np.stack(sides))], names=["stream", "channel", "seq", "floor", "side"])

    shape = "stream bigint, channel int, seq bigint, floor array<double>, side array<double>"
    return blocks.select("stream", "channel", "seq", "code", "samples").groupBy("stream", "channel").applyInArrow(scan, shape)


def _tail(tail: int, code: int, previous: int) -> int:
    """Blocks since a short variant began, up to 8; long codes end it."""
    tail = 0 if code >= 2 else tail
    if previous != 0 or code != 1:
        return tail + 1 if 0 < tail < 8 else tail
    return 1


def _list(rows: np.ndarray) -> pa.Array:
    ends = (np.arange(len(rows) + 1) * rows.shape[-1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def curve(x: Column, f) -> Column:
    """``f`` of whole arrays of one length, a batch at a time."""

    @pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(rows.to_list()).astype(np.float64))), dtype=object) if len(rows) else pd.Series([], dtype=object)

    return run(x)
