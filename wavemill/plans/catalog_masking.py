"""Queries over masking operators, each held against SQL written from its rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.operators import masking as M
from wavemill.operators import schedule
from wavemill.plans.catalog import PACKETS, SPEC, _rows64, query, rounded
from wavemill.sources import adapters as A

SHAPE = M.geometry(64, 48000)


#: Decibels a doubling, as the method's constants have it.
STEP = f"{7.1771142984e-7 * 2**23!r}::DOUBLE"


def _log(x: str) -> str:
    """SQL for the bit logarithm of a number above 0: exponent and mantissa as one line."""
    return f"({STEP} * (floor(log2({x})) + 127 + {x} / pow(2.0::DOUBLE, floor(log2({x}))) - 1) - 764.6162109375::DOUBLE)"


LOGS = f"{SPEC}, logs AS (SELECT idx, stream, bin, CASE WHEN coeff = 0 THEN -764.6162109375::DOUBLE ELSE {_log('abs(coeff)')} END + 0.345::DOUBLE AS raw FROM spec)"


def _raw(spark, sf_dir):
    return _rows64(spark, sf_dir).withColumn("raw", M.curve(F.col("x"), M.spectrum_log))


@query(f"WITH {LOGS} SELECT idx, bin, round(raw, 4) + 0.0::DOUBLE AS raw FROM logs")
def q72_log_curve(spark, sf_dir):
    """Levels read off the bits of coefficients."""
    return _raw(spark, sf_dir).select("idx", F.posexplode("raw").alias("bin", "raw")).select("idx", "bin", rounded("raw", 4).alias("raw"))


def _power(k: str) -> str:
    return f"pow(sum(coeff * cos(2 * pi() * {k} * bin / 64)), 2) + pow(sum(coeff * sin(2 * pi() * {k} * bin / 64)), 2)"


@query(f"""WITH {SPEC}, k AS (SELECT unnest(range(32))::INT AS k), p AS (SELECT idx, k, {_power('k')} AS p, abs(sum(coeff)) AS s FROM spec, k GROUP BY idx, k)
SELECT idx, k AS bin, round(CASE WHEN k = 0 THEN {_log('s')} ELSE 0.5::DOUBLE * {_log('p')} END + {_log('0.0625::DOUBLE')} + 0.69::DOUBLE, 2) + 0.0::DOUBLE AS level FROM p""")
def q73_power_curve(spark, sf_dir):
    """The log curve of Fourier power."""
    rows = _rows64(spark, sf_dir).withColumn("p", M.curve(F.col("x"), M.power_log))
    return rows.select("idx", F.posexplode("p").alias("bin", "p")).select("idx", "bin", rounded("p", 2).alias("level"))


def _windows(low, high, n: int = 64) -> str:
    """The window behind each bin: its own, or the last whole one."""
    whole = next((i for i in range(n) if high[i] >= n), n)
    rows = [(i, abs(int(low[min(i, whole - 1)])), int(high[min(i, whole - 1)]), 1 if low[min(i, whole - 1)] < 0 else -1) for i in range(n)]
    return "(VALUES " + ", ".join(map(str, rows)) + ") AS t(place, a, b, turned)"


def _smoothed(source: str, offset: float, low, high) -> str:
    """SQL for weighted lines of ``source`` (idx, bin, y over 0) over windows; idx, place, line."""
    even, odd = "((bin <= b)::INT + turned * (bin <= a)::INT)", "((bin <= b)::INT - (bin <= a)::INT)"
    return f"""SELECT idx, place, (s2 * t0 - s1 * t1) / d + (s0 * t1 - s1 * t0) / d * place AS line FROM (
SELECT *, s0 * s2 - s1 * s1 AS d FROM (
SELECT idx, place, sum(w * {even}) AS s0, sum(w * greatest(bin, (bin = 0)::INT) * {odd}) AS s1, sum(w * bin * bin * {even}) AS s2,
sum(w * y * {even}) AS t0, sum(w * bin * y * {odd}) AS t1
FROM (SELECT idx, bin, greatest(v + {offset}::DOUBLE, 1.0::DOUBLE) AS y, pow(greatest(v + {offset}::DOUBLE, 1.0::DOUBLE), 2) * CASE WHEN bin = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM {source})
JOIN {_windows(low, high)} ON bin <= greatest(a, b) GROUP BY idx, place))"""


FIXED = 40
_END = np.arange(64) + FIXED // 2


@query(f"""WITH {LOGS}, vs AS (SELECT idx, bin, raw AS v FROM logs),
wide AS ({_smoothed('vs', 140.0, SHAPE.low, SHAPE.high)}), narrow AS ({_smoothed('vs', 140.0, _END - FIXED, _END)})
SELECT wide.idx, wide.place AS bin, round(greatest(wide.line, 0) - 140, 4) + 0.0::DOUBLE AS smooth, round(least(greatest(wide.line, 0), narrow.line) - 140, 4) + 0.0::DOUBLE AS lower
FROM wide JOIN narrow ON narrow.idx = wide.idx AND narrow.place = wide.place""")
def q74_curve_smooth(spark, sf_dir):
    """Log curves smoothed over critical bands, and the lower of that and a line over a fixed window."""
    rows = _raw(spark, sf_dir)
    rows = rows.withColumn("s", M.curve(F.col("raw"), lambda c: M.smooth(c, SHAPE.low, SHAPE.high, 140.0)))
    rows = rows.withColumn("l", M.curve(F.col("raw"), lambda c: M.smooth(c, SHAPE.low, SHAPE.high, 140.0, FIXED)))
    each = rows.select("idx", F.posexplode(F.arrays_zip("s", "l")).alias("bin", "p"))
    return each.select("idx", "bin", rounded("p.s", 4).alias("smooth"), rounded("p.l", 4).alias("lower"))


@query(f"""WITH {SPEC} SELECT idx, bin, max(coeff) OVER (PARTITION BY idx ORDER BY bin ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS held FROM spec""")
def q75_seed_chase(spark, sf_dir):
    """Seeds that hold on for six lines, unless a greater one comes."""
    rows = _rows64(spark, sf_dir).select("idx", M.curve(F.col("x"), lambda c: M.chase(c, 6)).alias("h"))
    return rows.select("idx", F.posexplode("h").alias("bin", "held"))


@query(f"""WITH {LOGS}, b AS (SELECT *, lag(raw) OVER (PARTITION BY stream, bin ORDER BY idx) AS before FROM logs)
SELECT idx, bin, round(CASE WHEN raw - (-40 + bin % 5) >= 12 AND raw - coalesce(before, 0.0::DOUBLE) >= 1 THEN raw - coalesce(before, 0.0::DOUBLE) ELSE 0 END, 3) + 0.0::DOUBLE AS peak FROM b""")
def q76_coupling_peak(spark, sf_dir):
    """How far bins have risen since the block before, where they stand clear of the noise."""
    each = _raw(spark, sf_dir).select("idx", "stream", F.posexplode("raw").alias("bin", "raw"))
    before = F.coalesce(F.lag("raw").over(W.partitionBy("stream", "bin").orderBy("idx")), F.lit(0.0))
    peak = M.coupling_peak(F.col("raw"), before, F.lit(-40.0), F.pmod("bin", F.lit(5)).cast("double"))
    return each.select("idx", "bin", rounded(peak, 3).alias("peak"))


LEVEL_PAIR = f"{SPEC}, l AS (SELECT idx, bin, coeff * 60 - 50 AS tone, -45 - bin * 0.25::DOUBLE AS noise, coeff * 40 - 40 AS source FROM spec)"


@query(f"""WITH {LEVEL_PAIR}, f AS (SELECT *, least(noise + bin % 3, -48.0::DOUBLE) AS low, tone + 30 - CASE WHEN bin <= 10 THEN 0.5::DOUBLE * 5 ELSE 0 END AS target FROM l),
c AS (SELECT *, CASE WHEN low > target THEN low WHEN bin <= 10 OR bin >= 40 OR source >= target THEN target WHEN source >= low THEN source ELSE 0.7::DOUBLE * target + 0.3::DOUBLE * low END AS chosen, low - source + 17.2::DOUBLE AS away FROM f)
SELECT idx, bin, round(chosen, 6) + 0.0::DOUBLE AS floor, round(CASE WHEN away <= 0 THEN 1 - away * 0.00045::DOUBLE WHEN away * 0.0075::DOUBLE > 1 THEN 0.0001::DOUBLE ELSE 1 - away * 0.0075::DOUBLE END, 6) + 0.0::DOUBLE AS side FROM c""")
def q77_floor_choice(spark, sf_dir):
    """The floor of each bin from tone, noise and source, and what its coefficient is scaled by."""
    bin_, coeff = F.col("bin"), F.col("coeff")
    tone, noise, source = coeff * 60 - 50, -45 - bin_ * 0.25, coeff * 40 - 40
    mask = F.pmod(bin_, F.lit(3)).cast("double")
    floor = M.floor_choice(tone, noise, mask, source, bin_, 30.0, -48.0, 0.5, 10, 40, 0.3)
    side = M.side_factor(F.least(noise + mask, F.lit(-48.0)) - source, 1.5)
    return A.spectrum(spark, sf_dir).select("idx", "bin", rounded(floor).alias("floor"), rounded(side).alias("side"))


@query(f"""WITH {PACKETS}, c AS (SELECT stream, seq, mode, lag(mode) OVER w AS before, row_number() OVER w AS k FROM packets WINDOW w AS (PARTITION BY stream ORDER BY seq)),
g AS (SELECT *, sum(coalesce((mode <> before)::INT, 0)) OVER (PARTITION BY stream ORDER BY seq) AS isl FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, isl ORDER BY seq) AS run FROM g)
SELECT stream, seq, (mode = 0)::INT AS active,
round(CASE WHEN mode = 1 THEN 0 ELSE (CASE WHEN coalesce(before, 0) = 1 THEN 0.7::DOUBLE WHEN run >= 8 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE - (run - 1) / 17.0::DOUBLE END)
 * CASE WHEN least(8, run - 1) = 0 THEN 1 ELSE least(8, run - 1) / 8.0::DOUBLE END END, 9) + 0.0::DOUBLE AS lower,
CASE WHEN mode = 1 OR coalesce(before, 0) = 1 THEN 0.0::DOUBLE WHEN run >= 8 THEN 25.0::DOUBLE ELSE run * 3.0::DOUBLE END AS rebase,
CASE WHEN mode = 1 THEN 0.0::DOUBLE WHEN coalesce(before, 0) = 1 THEN 8.0::DOUBLE WHEN run >= 8 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE - run END AS chase FROM r""")
def q78_temporal_kernel(spark, sf_dir):
    """How much short blocks lean on the blocks before them, from runs of modes."""
    rows = schedule.runs(A.packets(spark, sf_dir).select("stream", "seq", "mode"))
    before = F.coalesce(F.lag("mode").over(W.partitionBy("stream").orderBy("seq")), F.lit(0))
    rows = rows.withColumn("k", M.temporal_kernel(F.col("run"), F.col("tail"), F.col("mode"), before, 6.0))
    return rows.select("stream", "seq", "k.active", rounded("k.lower", 9).alias("lower"), "k.rebase", "k.chase")


@query(f"""WITH {SPEC}, pairs AS (SELECT idx, bin // 2 AS slot, sum(coeff * coeff) AS p FROM spec GROUP BY idx, bin // 2), m AS (SELECT idx, avg(coeff * coeff) AS mean FROM spec GROUP BY idx)
SELECT idx, slot::INT AS slot, round(greatest(0.5::DOUBLE * {_log('mean')} - 15 - 8 * slot, 0.5::DOUBLE * {_log('p')}, -85.0::DOUBLE), 2) + 0.0::DOUBLE AS level FROM pairs JOIN m USING (idx)""")
def q79_transient_mask(spark, sf_dir):
    """Levels of pairs of bins over a floor that falls from the mean energy."""
    rows = _rows64(spark, sf_dir).withColumn("m", M.curve(F.col("x"), lambda c: M.transient_mask(c, (c**2).mean(axis=-1))))
    return rows.select("idx", F.posexplode("m").alias("slot", "m")).select("idx", "slot", rounded("m", 2).alias("level"))


BAND_LIMITS = [0.3 + 0.02 * k for k in range(12)]


@query(f"""WITH {SPEC}, n AS (SELECT *, lag(coeff) OVER w AS last, max(coeff) OVER h AS top, min(coeff) OVER h AS foot FROM spec WHERE bin < 12
WINDOW w AS (PARTITION BY stream, bin ORDER BY idx), h AS (PARTITION BY stream, bin ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING)),
f AS (SELECT stream, idx, (greatest(coeff, coalesce(last, coeff)) - top > 0.3::DOUBLE + 0.02::DOUBLE * bin + 0.1::DOUBLE) AS up, (least(coeff, coalesce(last, coeff)) - foot < -0.3::DOUBLE - 0.02::DOUBLE * bin - 0.1::DOUBLE) AS down FROM n)
SELECT stream, idx, (CASE WHEN bool_or(up) THEN 5 ELSE 0 END | CASE WHEN bool_or(down) THEN 2 ELSE 0 END)::INT AS flags FROM f GROUP BY stream, idx""")
def q80_band_flags(spark, sf_dir):
    """Which quanta rise out of, or fall out of, the history of some band."""
    rows = _rows64(spark, sf_dir).select("stream", "idx", F.slice("x", 1, 12).alias("bands"))
    flags = M.band_flags(rows, 5, BAND_LIMITS, [-v for v in BAND_LIMITS], F.lit(0.1), "stream", "idx")
    return flags.select("stream", "idx", F.col("flags").cast("int").alias("flags"))
