"""Masking operators against their rules, bin by bin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import codec, masking as M, schedule

RNG = np.random.default_rng(11)


def test_geometry():
    g = M.geometry(256, 48000)
    z = M.bark(np.arange(256) * g.rate / 512)
    for k in range(256):
        low = [b for b in range(-99, k + 1) if M.bark(np.array(b * g.rate / 512)) >= z[k] - 0.5]
        assert g.low[k] == min(low[0], k - 4) - 1
    assert (np.diff(g.octave) >= 0).all() and g.octave[0] == 0 and g.lines > g.octave[-1]
    assert 2000 < np.argmin(g.threshold) * g.rate / 512 < 5000  # hearing is keenest there


def test_logs():
    x = np.array([1.0, 2.0, 0.5, -1.0])
    assert M.bit_log(x) == pytest.approx([0.0, 6.0206, -6.0206, 0.0], abs=1e-3)
    n = 64
    s = np.sin(2 * np.pi * 8 * np.arange(n) / n)
    assert M.power_log(s[None]).argmax() == 8 and M.power_log(s[None]).max() == pytest.approx(6.02 + 0.69, abs=0.3)


def smooth_by_bins(curve, low, high, offset, fixed):
    n, line, out = len(curve), (0.0, 0.0), []
    y = np.maximum(curve + offset, 1.0)
    w = y * y
    w[0] /= 2

    def fit(a, b):
        sums = np.zeros(5)
        for k in range(n):
            even = (k <= b) + (1 if a < 0 else -1) * (k <= abs(a))
            odd = int(k <= b) - int(k <= abs(a))
            x = max(k, 1) if k == 0 else k
            sums += [w[k] * even, w[k] * x * odd, w[k] * k * k * even, w[k] * y[k] * even, w[k] * k * y[k] * odd]
        s0, s1, s2, t0, t1 = sums
        d = s0 * s2 - s1 * s1
        return (s2 * t0 - s1 * t1) / d, (s0 * t1 - s1 * t0) / d

    def along(starts, ends):
        got, line = [], (0.0, 0.0)
        for k in range(n):
            if ends[k] < n and len(got) == k and all(e < n for e in ends[: k + 1]):
                line = fit(starts[k], ends[k])
            got.append(line[0] + line[1] * k)
        return np.array(got)

    out = np.maximum(along(low, high), 0) - offset
    if fixed:
        ends = np.arange(n) + fixed // 2
        out = np.minimum(out, along(ends - fixed, ends) - offset)
    return out


@pytest.mark.parametrize("fixed", [0, 30])
def test_smooth(fixed):
    g = M.geometry(64, 44100)
    for _ in range(5):
        curve = RNG.normal(-60, 15, 64)
        got = M.smooth(curve[None], g.low, g.high, 140.0, fixed)[0]
        assert np.allclose(got, smooth_by_bins(curve, g.low, g.high, 140.0, fixed), atol=1e-6)


def test_chase_is_a_sliding_maximum():
    for lines in (0, 1, 3, 4, 7):
        x = RNG.normal(0, 1, (3, 50))
        want = np.stack([[row[max(0, k - lines) : k + 1].max() for k in range(50)] for row in x])
        assert (M.chase(x, lines) == want).all()


def test_relax_takes_bins_in_order():
    raw, history = RNG.normal(-40, 20, 40), RNG.normal(-60, 20, 40)
    widths = RNG.integers(1, 8, 40)
    want = history.copy()
    for k in range(40):
        for j in range(1, widths[k]):
            if k + j < 40 and raw[k] - j * 75 / widths[k] > want[k + j]:
                want[k + j] += 5 / widths[k + j]
    assert np.allclose(M.relax(history, raw, widths), want)


def test_peaks_are_suppressed():
    curve = np.full(128, -60.0)
    curve[40] = -30.0
    base = np.full(128, -58.0)
    out = M.suppress_short(curve, base, np.full(128, 12.0), 120)
    assert (out[39:42] == -70.0).all() and (np.delete(out, range(37, 44)) == -58).all()
    assert (M.suppress_short(curve, base, np.full(128, 50.0), 120)[40] == pytest.approx(-58 - 30 if base[40] >= curve[40] else -58 - (30 - 9) * 0.6))
    flat = np.full((1, 1024), -50.0)
    flat[0, 400:408] = -30
    out = M.suppress_long(flat, np.full(1024, 6.0), 1024)
    changed = np.flatnonzero(out[0] != flat[0])
    assert changed.min() >= 376 and changed.max() <= 432 and (out[0, 400:408] == -36).all()
    assert (M.suppress_long(np.full((2, 64), -1.0), np.ones(64), 64) == -1).all()


def test_tone_floor_is_over_the_threshold_and_under_its_tone():
    g = M.geometry(256, 48000)
    level = np.full((2, 256), -120.0)
    level[1, 60] = -10.0
    floor = M.tone_floor(level, level.max(axis=1), level.max(axis=1), g)
    alone = M.tone_floor(level[:1], level[:1].max(axis=1), level[:1].max(axis=1), g)
    assert (floor[0] == alone[0]).all()  # rows don't touch
    lifted = floor[1] - (g.threshold + max(-10.0 - 40, -140))
    assert (lifted >= -1e-9).all() and lifted[60] > 0
    assert floor[1].max() <= -10.0


def test_short_envelope_of_silence_and_of_an_onset():
    g, n = M.geometry(128, 48000), 128
    p = M.Envelope(np.zeros(n))
    quiet, loud = np.full(n, -90.0), np.full(n, -20.0)
    noise, tone, side = np.full(n, -30.0), np.full(n, -70.0), np.ones(n)
    off = M.kernel_of(1, 0, 1, 0, p.bias)
    floor, _, history, groups = M.short_envelope(tone, noise, loud, side, quiet, quiet, off, 0, 0, p, g.widths)
    assert (floor == -30).all() and (history == quiet).all() and not groups.any()
    on = M.kernel_of(1, 0, 0, 1, p.bias)
    floor, scaled, history, groups = M.short_envelope(tone, noise, loud, side, quiet, quiet, on, 0, 1, p, g.widths)
    assert (floor < -30).all() and (floor >= quiet).all() and (history == loud).all() and (groups == -1).all()
    assert (np.diff(floor[[2, 10, 20, 60]]) <= 0).all()  # less near the bottom
    assert scaled.shape == (n,)


def test_kernel_columns_equal_the_rule(spark):
    rows = [(r, t, c, b) for r in (1, 3, 8, 12) for t in (0, 2, 8) for c in (0, 1, 2) for b in (0, 1)]
    df = spark.createDataFrame(rows, "run int, tail int, code int, previous int")
    got = df.select("*", M.temporal_kernel(*map(F.col, ("run", "tail", "code", "previous")), 2.0).alias("k")).collect()
    for r in got:
        assert tuple(r.k) == pytest.approx(tuple(map(float, M.kernel_of(r.run, r.tail, r.code, r.previous, 2.0))))


def tones(n: int, count: int) -> list:
    k = np.arange(n)
    w = np.sin(np.pi * (k + 0.5) / n)
    return [((0.4 * np.sin(0.2 * k + s) + 0.01 * RNG.normal(0, 1, n)) * w).tolist() for s in range(count)]


def test_long_analysis(spark):
    n, offsets = 512, [-6.0 + 0.2 * k for k in range(40)]
    rows = [(1, c, s, x) for c in (0, 1) for s, x in enumerate(tones(n, 5))]
    blocks = spark.createDataFrame(rows, "stream bigint, channel int, seq bigint, samples array<double>")
    got = {(r.channel, r.seq): r for r in M.analyse_long(blocks, 48000, n, offsets).collect()}
    assert len(got) == 10 and all(len(r.floor) == len(r.side) == len(r.peak) == n // 2 for r in got.values())
    again = {(r.channel, r.seq): r for r in M.analyse_long(blocks.repartition(5), 48000, n, offsets).collect()}
    assert got == again
    bin_ = int(round(0.2 / (2 * np.pi) * n))
    assert all(np.argmax(r.floor) in range(bin_ - 6, bin_ + 7) for r in got.values() if r.seq)
    assert M.analyse_long(blocks.limit(0), 48000, n, offsets).count() == 0


def test_short_analysis(spark):
    n, offsets = 256, [-6.0 + 0.2 * k for k in range(40)]
    rows = [(1, c, s, int(s % 3 == 0), x) for c in (0, 1) for s, x in enumerate(tones(n, 6))]
    blocks = spark.createDataFrame(rows, "stream bigint, channel int, seq bigint, code int, samples array<double>")
    got = {(r.channel, r.seq): r for r in M.analyse_short(blocks, 48000, n, offsets).collect()}
    assert len(got) == 12 and all(np.isfinite(r.floor).all() and len(r.side) == n // 2 for r in got.values())
    one = {(r.channel, r.seq): r for r in M.analyse_short(blocks.where("channel = 1"), 48000, n, offsets).collect()}
    assert all(got[k] == r for k, r in one.items())  # channels don't touch
    assert M.analyse_short(blocks.limit(0), 48000, n, offsets).count() == 0


def test_two_levels_equal_one(spark):
    rows = [(int(s), int(i), int(v), float(p)) for s in range(3) for i, v, p in zip(range(0, 400, 3), RNG.integers(0, 8, 134), RNG.normal(-20, 9, 134))]
    df = spark.createDataFrame(rows, "stream int, i int, flags int, peak double")
    for f in (lambda part: schedule.history_counter(df, part=part), lambda part: schedule.leaky_peak(df, 0.75, at="i", part=part)):
        one, two = (np.array(sorted(map(tuple, f(part).collect()))) for part in (1 << 16, 7))
        assert np.allclose(one, two)
    carried = schedule.leaky_peak(df, 0.75, at="i", carried=50.0).where("i = 0").select("leaky").collect()
    assert {r.leaky for r in carried} == {49.25}


def test_modes_by_scan():
    slots = np.zeros(200, np.int64)
    slots[[40, 41, 120]] = 1
    modes = codec.scan_modes(slots, 12000)
    assert modes[0] == 0 and 0 in modes[1:] and 1 in modes
    assert codec.scan_modes(np.zeros(0, np.int64), 3000)[1:] == [1] * (len(codec.scan_modes(np.zeros(0, np.int64), 3000)) - 1)
