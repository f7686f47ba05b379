"""The registered queries over signal operators, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import coupling as C
from wavemill.functions import numeric as N
from wavemill.operators import codec, container, entropy, floors, framing, posts, quality, schedule, spectral
from wavemill.plans.runtime import scratch, ship, table
from wavemill.sources import adapters as A
from wavemill.streaming import overlap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PCM = """pcm AS (
  SELECT event_id, user_id, (event_id % 2)::INT AS channel, (event_id // 2)::BIGINT AS frame,
         greatest(-32768, least(32767, sign(x) * floor(abs(x * 32768.0::DOUBLE) + 0.5::DOUBLE)))::INT AS sample
  FROM (SELECT *, (value - 50.0::DOUBLE) / 512.0::DOUBLE AS x FROM events))"""
SPEC = """rows AS (SELECT vec_id AS idx, label AS stream, embedding AS v FROM embeddings),
spec AS (SELECT idx, stream, (generate_subscripts(v, 1) - 1)::INT AS bin, unnest(v)::DOUBLE AS coeff FROM rows)"""
PACKETS = """packets AS (
  SELECT conv_id AS stream, turn AS seq, (role = 'assistant')::INT AS mode, octet_length(encode(coalesce(text, '')))::BIGINT AS size
  FROM conversations)"""
HALF_AWAY = "(sign({0}) * floor(abs({0}) + 0.5::DOUBLE))::BIGINT"


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL if it has one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(x, digits: int = 6):
    """Rounded for comparison; adds 0.0 so that -0.0 is 0.0."""
    return F.round(x, digits) + 0.0


def _rows64(spark, sf_dir):
    """All spectrum rows that hold anything, as 64 bins: shorter ones end in zeros, and bins beyond belong to no transform of 64."""
    rows = A.spectrum_rows(spark, sf_dir).where(F.size("x") > 0)
    return rows.withColumn("x", F.slice(F.concat("x", F.array_repeat(F.lit(0.0), 64)), 1, 64))


# Samples ---------------------------------------------------------------------------------------


@query(f"WITH {PCM} SELECT event_id, channel, frame, sample, sample / 32768.0::DOUBLE AS x FROM pcm")
def q01_pcm_quantize(spark, sf_dir):
    rows = A.pcm(spark, sf_dir).withColumn("x", N.domain(F.col("sample")))
    return rows.where(N.in_domain(F.col("x"))).select("event_id", "channel", "frame", "sample", "x")


@query(f"""WITH {PCM}, wide AS (SELECT event_id, greatest(-8388608, least(8388607, sample * 256 + event_id % 256 - 128))::INT AS s FROM pcm)
SELECT event_id, s AS sample24, greatest(-32768, least(32767, CASE WHEN s >= 0 THEN (s + 128) // 256 ELSE -((-s + 128) // 256) END))::INT AS sample
FROM wide""")
def q02_pcm_24_to_16(spark, sf_dir):
    wide = F.col("sample") * 256 + F.pmod("event_id", F.lit(256)) - 128
    rows = A.pcm(spark, sf_dir).select("event_id", N.clamp(wide, -8388608, 8388607).cast("int").alias("sample24"))
    return rows.withColumn("sample", N.int24_to_int16(F.col("sample24")))


@query(f"""WITH {PCM} SELECT channel, frame // 1024 AS block, count(*) AS n, sum(sample)::BIGINT AS total,
min(frame) AS first_frame, max(sample) AS peak FROM pcm GROUP BY ALL""")
def q03_deinterleave(spark, sf_dir):
    flat = A.pcm(spark, sf_dir).select(F.col("event_id").alias("pos"), "sample")
    rows = framing.deinterleave(flat, 2).withColumn("block", framing.delivery_block(F.col("frame")))
    return rows.groupBy("channel", "block").agg(
        F.count("*").alias("n"), F.sum("sample").alias("total"), F.min("frame").alias("first_frame"), F.max("sample").alias("peak")
    )


@query(f"""WITH {PCM}, last AS (SELECT channel, max(frame) AS m FROM pcm GROUP BY channel),
each AS (SELECT channel, frame // 64 AS q, sample, m FROM pcm JOIN last USING (channel)
  UNION ALL SELECT channel, frame // 64 - 1, sample, m FROM pcm JOIN last USING (channel) WHERE frame >= 64)
SELECT channel, q, count(*) AS n, sum(sample::BIGINT * sample)::BIGINT AS energy FROM each WHERE q * 64 + 127 <= m GROUP BY channel, q""")
def q04_frame_energy(spark, sf_dir):
    frames = framing.sliding(A.pcm(spark, sf_dir), 128, 64)
    s = F.col("sample").cast("bigint")
    return frames.groupBy("channel", "q").agg(F.count("*").alias("n"), F.sum(s * s).alias("energy"))


# Schedules -------------------------------------------------------------------------------------


@query(f"""WITH {PACKETS}, near AS (
  SELECT stream, seq, mode, CASE WHEN mode = 1 THEN 2048 ELSE 256 END AS bs,
         coalesce(lead(mode) OVER w, 1) AS following, coalesce(lag(mode) OVER w, 0) AS previous
  FROM packets WINDOW w AS (PARTITION BY stream ORDER BY seq)),
steps AS (SELECT *, (bs + CASE WHEN following = 1 THEN 2048 ELSE 256 END) // 4 AS advance FROM near),
placed AS (SELECT *, coalesce(sum(advance) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1024 - bs // 2 AS sample_start FROM steps)
SELECT stream, seq, previous, mode, following, advance::BIGINT AS advance, sample_start, sample_start + bs AS sample_end FROM placed""")
def q05_block_schedule(spark, sf_dir):
    plan = schedule.plan(A.packets(spark, sf_dir).select("stream", "seq", "mode"))
    return plan.select("stream", "seq", "previous", "mode", "following", "advance", "sample_start", "sample_end")


FLAGS = f"{PCM}, flagged AS (SELECT user_id AS stream, event_id AS i, (sample & 7)::INT AS flags FROM pcm)"


def _flags(spark, sf_dir):
    return A.user_signal(spark, sf_dir).select("stream", "i", F.col("sample").bitwiseAND(F.lit(7)).alias("flags"))


@query(f"""WITH {FLAGS} SELECT stream, i, flags, ((flags & 3) <> 0 OR (coalesce(lag(flags) OVER w, 0) & 1) <> 0
OR (coalesce(lead(flags) OVER w, 0) & 2) <> 0)::INT AS slot FROM flagged WINDOW w AS (PARTITION BY stream ORDER BY i)""")
def q06_transient_queue(spark, sf_dir):
    return schedule.transient_queue(_flags(spark, sf_dir))


@query(f"""WITH {FLAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY i) - 1 AS k FROM flagged),
r AS (SELECT *, max(CASE WHEN flags & 4 <> 0 THEN k END) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM n)
SELECT stream, i, flags, least(24, coalesce(k - last - 1, k))::INT AS history FROM r""")
def q07_history_counter(spark, sf_dir):
    return schedule.history_counter(_flags(spark, sf_dir))


@query(f"""WITH {PACKETS} SELECT stream, seq, mode, (mode * 2 + CASE WHEN mode = 1 AND coalesce(lag(mode) OVER
(PARTITION BY stream ORDER BY seq), 0) <> 0 THEN 1 ELSE 0 END)::INT AS code FROM packets""")
def q08_transition_code(spark, sf_dir):
    return schedule.transition_code(A.packets(spark, sf_dir).select("stream", "seq", "mode"))


@query(f"""WITH {PACKETS}, c AS (SELECT stream, seq, mode, coalesce((mode <> lag(mode) OVER w)::INT, 0) AS ch FROM packets
WINDOW w AS (PARTITION BY stream ORDER BY seq)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isl FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, isl ORDER BY seq)::INT AS run FROM g)
SELECT stream, seq, mode, run, least(8, run - 1)::INT AS tail FROM r""")
def q09_run_tail_counters(spark, sf_dir):
    return schedule.runs(A.packets(spark, sf_dir).select("stream", "seq", "mode"))


@query(f"""WITH {SPEC}, peaks AS (SELECT stream, idx, least(0.0::DOUBLE, max(CASE WHEN coeff = 0 THEN -200.0::DOUBLE ELSE 20.0::DOUBLE * log10(abs(coeff)) END)) AS peak FROM spec GROUP BY stream, idx),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx)::DOUBLE AS k FROM peaks)
SELECT stream, idx, round(peak, 6) + 0.0::DOUBLE AS peak,
       round(max(peak + k * 0.75::DOUBLE) OVER (PARTITION BY stream ORDER BY idx ROWS UNBOUNDED PRECEDING) - k * 0.75::DOUBLE, 6) + 0.0::DOUBLE AS leaky FROM n""")
def q10_leaky_peak(spark, sf_dir):
    top = F.array_max(F.transform("x", lambda c: N.db(c)))
    peaks = A.spectrum_rows(spark, sf_dir).select("stream", "idx", F.least(F.lit(0.0), top).alias("peak"))
    out = schedule.leaky_peak(peaks, 0.75)
    return out.select("stream", "idx", rounded("peak").alias("peak"), rounded("leaky").alias("leaky"))


@query(f"""WITH RECURSIVE {PCM}, x AS (SELECT user_id AS stream, event_id AS i, (sample / 32768.0::DOUBLE)::FLOAT AS x,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM pcm),
run(stream, i, k, x, y) AS (SELECT stream, i, k, x, x FROM x WHERE k = 1
  UNION ALL SELECT n.stream, n.i, n.k, n.x, ((n.x - r.x)::FLOAT + (0.9921875::FLOAT * r.y)::FLOAT)::FLOAT FROM run r JOIN x n ON n.stream = r.stream AND n.k = r.k + 1)
SELECT stream, i, y::DOUBLE AS y FROM run""")
def q11_dc_filter(spark, sf_dir):
    return spectral.dc_filter(A.user_signal(spark, sf_dir))


# Transforms ------------------------------------------------------------------------------------

HALF = "sin(1.5707963267948966::DOUBLE * pow(sin(({0} + 0.5::DOUBLE) * (1.5707963267948966::DOUBLE / 32)), 2))"


@query(f"""WITH {PCM}, last AS (SELECT channel, max(frame) AS m FROM pcm GROUP BY channel),
each AS (SELECT channel, frame // 32 AS q, frame % 32 AS pos, sample, m FROM pcm JOIN last USING (channel)
  UNION ALL SELECT channel, frame // 32 - 1, frame % 32 + 32, sample, m FROM pcm JOIN last USING (channel) WHERE frame >= 32),
w AS (SELECT channel, q, pos, sample * CASE WHEN pos < 32 THEN {HALF.format('pos')} ELSE {HALF.format('(63 - pos)')} END AS y FROM each WHERE q * 32 + 63 <= m)
SELECT channel, q, round(sum(y), 4) + 0.0::DOUBLE AS total, round(sum(y * y), 3) + 0.0::DOUBLE AS energy FROM w GROUP BY channel, q""")
def q12_windowed_frames(spark, sf_dir):
    frames = framing.sliding(A.pcm(spark, sf_dir), 64, 32)
    y = F.col("sample") * framing.hybrid_window(F.col("pos"), 64, 64, 64)
    return frames.groupBy("channel", "q").agg(rounded(F.sum(y), 4).alias("total"), rounded(F.sum(y * y), 3).alias("energy"))


@query(f"""WITH {SPEC}, basis AS (SELECT i::INT AS bin, k::INT AS k, cos(pi() / 128 * (2 * i + 1 + 32) * (2 * k + 1)) * 4.0::DOUBLE / 64 AS b
FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(32)) AS k))
SELECT idx, k, round(sum(coeff * b), 6) + 0.0::DOUBLE AS x FROM spec JOIN basis USING (bin) GROUP BY idx, k""")
def q13_mdct(spark, sf_dir):
    rows = _rows64(spark, sf_dir)
    out = rows.select("idx", F.posexplode(spectral.mdct(F.col("x"), 64)).alias("k", "x"))
    return out.select("idx", "k", rounded("x").alias("x"))


FRAMES64 = f"""{PCM}, last AS (SELECT channel, max(frame) AS m FROM pcm GROUP BY channel),
each AS (SELECT channel, frame // 32 AS q, frame % 32 AS pos, sample / 32768.0::DOUBLE AS s, m FROM pcm JOIN last USING (channel)
  UNION ALL SELECT channel, frame // 32 - 1, frame % 32 + 32, sample / 32768.0::DOUBLE, m FROM pcm JOIN last USING (channel) WHERE frame >= 32),
win AS (SELECT p AS pos, CASE WHEN p < 32 THEN {HALF.format('p')} ELSE {HALF.format('(63 - p)')} END AS w FROM (SELECT unnest(range(64)) AS p)),
basis AS (SELECT i AS pos, k, cos(pi() / 128 * (2 * i + 1 + 32) * (2 * k + 1)) AS b FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(32)) AS k)),
coefs AS (SELECT channel, q, k, sum(s * w * b) * 4.0::DOUBLE / 64 AS c FROM each JOIN win USING (pos) JOIN basis USING (pos) WHERE q * 32 + 63 <= m GROUP BY channel, q, k),
back AS (SELECT channel, q * 32 + pos AS frame, sum(c * b) * w AS y FROM coefs JOIN basis USING (k) JOIN win USING (pos) GROUP BY channel, q, pos, w),
ola AS (SELECT channel, frame, sum(y) AS y FROM back GROUP BY channel, frame)"""


def _resynthesis(spark, sf_dir):
    frames = framing.sliding(A.pcm(spark, sf_dir), 64, 32)
    blocks = frames.groupBy("channel", "q").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "sample"))), lambda e: e["sample"] / 32768.0).alias("s")
    )
    back = blocks.select("channel", "q", spectral.imdct(spectral.mdct(F.col("s"), 64, True), 64, True).alias("y"))
    each = back.select("channel", "q", F.posexplode("y").alias("pos", "y"))
    return framing.overlap_add(each, F.col("q") * 32 + F.col("pos"))


@query(f"WITH {FRAMES64} SELECT channel, frame, round(y, 6) + 0.0::DOUBLE AS y FROM ola")
def q14_overlap_add(spark, sf_dir):
    return _resynthesis(spark, sf_dir).select("channel", "frame", rounded("y").alias("y"))


@query(f"""WITH {SPEC}, wave AS (SELECT i::INT AS bin, k::INT AS k, cos(2 * pi() * i * k / 64) AS c, sin(2 * pi() * i * k / 64) AS s
FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(33)) AS k))
SELECT idx, k, round(pow(sum(coeff * c), 2) + pow(sum(coeff * s), 2), 6) + 0.0::DOUBLE AS power FROM spec JOIN wave USING (bin) GROUP BY idx, k""")
def q15_power_spectrum(spark, sf_dir):
    rows = _rows64(spark, sf_dir)
    out = rows.select("idx", F.posexplode(spectral.power(F.col("x"), 64)).alias("k", "power"))
    return out.select("idx", "k", rounded("power").alias("power"))


@query(f"""WITH {PCM}, lags AS (SELECT unnest(range(17))::INT AS lag)
SELECT a.channel, lag, sum(a.sample::BIGINT * b.sample)::BIGINT AS r FROM lags, pcm a JOIN pcm b ON a.channel = b.channel AND b.frame = a.frame - lag GROUP BY a.channel, lag""")
def q16_autocorrelation(spark, sf_dir):
    return spectral.autocorrelation(A.pcm(spark, sf_dir), 16)


@query()
def q17_lpc_tail(spark, sf_dir):
    return spectral.lpc_tail(A.user_signal(spark, sf_dir), 16, 32)


# Floors ----------------------------------------------------------------------------------------


@query(f"""WITH {SPEC}, m AS (SELECT idx, bin, coeff * coeff AS w, CASE WHEN bin = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS h, greatest(bin, 1) AS x, coeff AS y FROM spec)
SELECT idx, bin, round(sum(h * w) OVER p, 6) + 0.0::DOUBLE AS w, round(sum(h * w * x) OVER p, 6) + 0.0::DOUBLE AS wx, round(sum(h * w * x * x) OVER p, 5) + 0.0::DOUBLE AS wxx,
round(sum(h * w * y) OVER p, 6) + 0.0::DOUBLE AS wy, round(sum(h * w * x * y) OVER p, 6) + 0.0::DOUBLE AS wxy FROM m
WINDOW p AS (PARTITION BY idx ORDER BY bin ROWS UNBOUNDED PRECEDING)""")
def q18_prefix_moments(spark, sf_dir):
    y = F.col("coeff")
    w = F.when(F.col("bin") == 0, 0.5).otherwise(1.0) * (y * y)
    x = F.greatest(F.col("bin"), F.lit(1))
    rows = schedule.prefix_sums(
        A.spectrum(spark, sf_dir), {"w": w, "wx": w * x, "wxx": w * x * x, "wy": w * y, "wxy": w * x * y}
    )
    digits = {"w": 6, "wx": 6, "wxx": 5, "wy": 6, "wxy": 6}
    return rows.select("idx", "bin", *(rounded(c, d).alias(c) for c, d in digits.items()))


@query(f"""WITH {SPEC}, f AS (SELECT idx, bin // 8 AS part, count(*)::DOUBLE AS n, sum(bin)::DOUBLE AS sx, sum(coeff) AS sy, sum(bin * bin)::DOUBLE AS sxx, sum(bin * coeff) AS sxy FROM spec GROUP BY idx, bin // 8)
SELECT idx, part, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) + 0.0::DOUBLE AS slope,
round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 6) + 0.0::DOUBLE AS start FROM f""")
def q19_interval_fit(spark, sf_dir):
    rows = A.spectrum(spark, sf_dir).withColumn("part", F.floor(F.col("bin") / 8))
    x, y = F.col("bin"), F.col("coeff")
    f = rows.groupBy("idx", "part").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")
    )
    slope = F.expr("(n * sxy - sx * sy) / (n * sxx - sx * sx)")
    f = f.withColumn("slope", slope)
    return f.select("idx", "part", rounded("slope").alias("slope"), rounded(F.expr("(sy - slope * sx) / n")).alias("start"))


DB = "CASE WHEN coeff = 0 THEN -200.0::DOUBLE ELSE 20.0::DOUBLE * log10(abs(coeff)) END"
LEVEL = f"greatest(0, least(1023, trunc(({DB}) * 7.314285755157471::DOUBLE + 1023.5::DOUBLE)))::INT"
LEVELS = f"{SPEC}, levels AS (SELECT idx, bin, coeff, {LEVEL} AS level FROM spec)"


def _levels(spark, sf_dir):
    return A.spectrum(spark, sf_dir).withColumn("level", N.level(N.db(F.col("coeff"))))


@query(f"WITH {LEVELS} SELECT idx, bin, level FROM levels")
def q20_db_quant(spark, sf_dir):
    return _levels(spark, sf_dir).select("idx", "bin", "level")


MOMENTS = ", ".join(
    f"coalesce(sum(CASE WHEN {'' if b == 'a' else 'NOT '}near THEN {v} END), 0)::BIGINT AS {n}_{b}"
    for b in "ab"
    for n, v in (("n", "1"), ("sx", "bin"), ("sy", "level"), ("sxx", "bin * bin"), ("sxy", "bin * level"))
)
ACCUMULATED = f"""{LEVELS}, near AS (SELECT *, bin // 16 AS part, level + 18 >= 800 AS near FROM levels),
moments AS (SELECT idx, part, {MOMENTS} FROM near GROUP BY idx, part)"""


def _moments(spark, sf_dir):
    rows = _levels(spark, sf_dir).withColumn("part", F.floor(F.col("bin") / 16))
    return floors.accumulate(rows, ("idx", "part"), F.col("level") + 18 >= 800, "bin", "level")


@query(f"WITH {ACCUMULATED} SELECT * FROM moments")
def q21_floor_accumulate(spark, sf_dir):
    return _moments(spark, sf_dir)


@query(f"""WITH {ACCUMULATED}, d AS (SELECT *, (n_a + n_b)::DOUBLE AS n, (sx_a + sx_b)::DOUBLE AS sx, (sy_a + sy_b)::DOUBLE AS sy, (sxx_a + sxx_b)::DOUBLE AS sxx, (sxy_a + sxy_b)::DOUBLE AS sxy FROM moments),
s AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM d)
SELECT idx, part, greatest(0, least(1023, floor((sy - slope * sx) / n + slope * (part * 16) + 0.5::DOUBLE)))::INT AS y0,
greatest(0, least(1023, floor((sy - slope * sx) / n + slope * (part * 16 + 15) + 0.5::DOUBLE)))::INT AS y1 FROM s""")
def q22_floor_line_fit(spark, sf_dir):
    m = _moments(spark, sf_dir)
    both = [(F.col(f"{c}_a") + F.col(f"{c}_b")).cast("double") for c in ("n", "sx", "sy", "sxx", "sxy")]
    begin = F.col("part") * 16
    return m.select("idx", "part", floors.line_fit(*both, begin).alias("y0"), floors.line_fit(*both, begin + 15).alias("y1"))


@query("""WITH posts AS (SELECT p_size AS x, row_number() OVER (ORDER BY (p_size * 37) % 53, p_size)::INT AS i FROM (SELECT DISTINCT p_size FROM part))
SELECT a.i, a.x, (SELECT b.i FROM posts b WHERE b.i < a.i AND b.x < a.x ORDER BY b.x DESC LIMIT 1) AS low,
(SELECT b.i FROM posts b WHERE b.i < a.i AND b.x > a.x ORDER BY b.x LIMIT 1) AS high FROM posts a""")
def q23_neighbour_posts(spark, sf_dir):
    from pyspark.sql.window import Window as W

    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("x")).distinct()  # a floor's posts: at most a few dozen
    return floors.neighbours(sizes.withColumn("i", F.row_number().over(W.orderBy(F.pmod(F.col("x") * 37, F.lit(53)), "x"))))


POST_SQL = f"""{LEVELS}, posts AS (SELECT idx, bin, level // 4 AS y FROM levels WHERE bin IN (0, 16, 32, 48, 63)),
spans AS (SELECT idx, bin AS x0, y AS y0, lead(bin) OVER w AS x1, lead(y) OVER w AS y1 FROM posts WINDOW w AS (PARTITION BY idx ORDER BY bin)),
render AS (SELECT idx, unnest(range(x0, CASE WHEN x1 = 63 THEN 64 ELSE x1 END))::INT AS bin, x0, y0, x1, y1 FROM spans WHERE x1 IS NOT NULL)"""


@query(f"""WITH {POST_SQL}, ys AS (SELECT idx, bin, (y0 + sign(y1 - y0) * floor(abs(y1 - y0) * (bin - x0) / (x1 - x0)))::BIGINT AS y FROM render)
SELECT idx, bin, y, round(pow(10.0::DOUBLE, (y - 255) * (7.0::DOUBLE / 256.0::DOUBLE)), 9) AS amplitude FROM ys""")
def q24_render_floor(spark, sf_dir):
    from pyspark.sql.window import Window as W

    posts = _levels(spark, sf_dir).where(F.col("bin").isin(0, 16, 32, 48, 63))
    posts = posts.select("idx", F.col("bin").alias("x0"), N.multiplier_level(F.col("level"), F.lit(1)).alias("y0"))
    w = W.partitionBy("idx").orderBy("x0")
    spans = posts.withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w)).where("x1 is not null")
    last = F.when(F.col("x1") == 63, 63).otherwise(F.col("x1") - 1)
    rows = spans.withColumn("bin", F.explode(F.sequence("x0", last)))
    y = N.line_point(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("bin"))
    return rows.select("idx", "bin", y.alias("y")).withColumn("amplitude", F.round(N.level_amplitude(F.col("y")), 9))


# Residues --------------------------------------------------------------------------------------

RESIDUE = f"{SPEC}, res AS (SELECT idx, bin, round_even(coeff / 0.0625::DOUBLE, 0)::BIGINT AS q FROM spec)"


def _residue(spark, sf_dir):
    return A.spectrum(spark, sf_dir).select("idx", "bin", floors.residue(F.col("coeff"), F.lit(0.0625)).alias("q"))


@query(f"WITH {RESIDUE} SELECT idx, bin, q FROM res")
def q25_residue_quantize(spark, sf_dir):
    return _residue(spark, sf_dir)


PAIRS = f"{RESIDUE}, pairs AS (SELECT a.idx, a.bin, a.q AS m, b.q AS a FROM res a JOIN res b ON a.idx = b.idx AND b.bin = a.bin + 32 WHERE a.bin < 32)"


def _pairs(spark, sf_dir):
    q = lambda e: floors.residue(e, F.lit(0.0625))
    rows = _rows64(spark, sf_dir)
    both = F.arrays_zip(F.slice("x", 1, 32).alias("m"), F.slice("x", 33, 32).alias("a"))
    rows = rows.select("idx", F.posexplode(both).alias("bin", "p"))
    return rows.select("idx", "bin", q(F.col("p.m")).alias("m"), q(F.col("p.a")).alias("a"))


@query(f"""WITH {PAIRS} SELECT idx, bin, m, a,
CASE WHEN m > 0 THEN CASE WHEN a < m THEN m ELSE a END WHEN a > m THEN m ELSE a END AS stored_m,
CASE WHEN m > 0 THEN m - a ELSE a - m END AS stored_a, true AS same FROM pairs""")
def q26_coupling_roundtrip(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("s", C.couple(F.col("m"), F.col("a")))
    rows = rows.withColumn("b", C.uncouple(F.col("s.m"), F.col("s.a")))
    same = (F.col("b.m") == F.col("m")) & (F.col("b.a") == F.col("a"))
    return rows.select("idx", "bin", "m", "a", F.col("s.m").alias("stored_m"), F.col("s.a").alias("stored_a"), same.alias("same"))


@query(f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN abs(m) > abs(a) THEN m ELSE a END AS big FROM pairs),
d AS (SELECT *, CASE WHEN big > 0 THEN m - a ELSE a - m END AS ang FROM c)
SELECT idx, bin, m, a, CASE WHEN ang >= 2 * abs(big) THEN -big ELSE big END AS magnitude, CASE WHEN ang >= 2 * abs(big) THEN -ang ELSE ang END AS angle FROM d""")
def q27_lossless_couple(spark, sf_dir):
    c = C.couple_lossless(F.col("m"), F.col("a"))
    rows = _pairs(spark, sf_dir).withColumn("c", c)
    return rows.select("idx", "bin", "m", "a", F.col("c.m").alias("magnitude"), F.col("c.a").alias("angle"))


MONO = f"""{RESIDUE}, parts AS (SELECT idx, bin // 8 AS part, max(abs(q)) AS peak, sum(abs(q))::BIGINT AS total, count(*) AS n FROM res GROUP BY idx, bin // 8),
classed AS (SELECT idx, part, peak, total, CASE {' '.join(f"WHEN peak <= {p}" + ('' if m < 0 else f" AND total * 100 // n < {m}") + f" THEN {k}" for k, (p, m) in enumerate(zip(floors.MONO_PEAK, floors.MONO_MEAN)))} ELSE 7 END AS cls FROM parts)"""


def _classes(spark, sf_dir):
    q = F.abs("q")
    parts = _residue(spark, sf_dir).groupBy("idx", F.floor(F.col("bin") / 8).alias("part"))
    parts = parts.agg(F.max(q).alias("peak"), F.sum(q).alias("total"), F.count("*").alias("n"))
    return parts.select("idx", "part", "peak", "total", floors.class_of_mono(F.col("peak"), F.col("total"), F.col("n")).alias("cls"))


@query(f"WITH {MONO} SELECT idx, part, peak, total, cls FROM classed")
def q28_partition_class_mono(spark, sf_dir):
    return _classes(spark, sf_dir)


@query(f"""WITH {PAIRS}, p AS (SELECT idx, bin // 8 AS part, max(abs(m)) AS magnitude, max(abs(a)) AS angle FROM pairs GROUP BY idx, bin // 8)
SELECT *, CASE {' '.join(f"WHEN magnitude <= {m} AND angle <= {a} THEN {k}" for k, (m, a) in enumerate(zip(floors.PAIR_MAGNITUDE, floors.PAIR_ANGLE)))} ELSE 9 END AS cls FROM p""")
def q29_partition_class_pair(spark, sf_dir):
    p = _pairs(spark, sf_dir).groupBy("idx", F.floor(F.col("bin") / 8).alias("part"))
    p = p.agg(F.max(F.abs("m")).alias("magnitude"), F.max(F.abs("a")).alias("angle"))
    return p.withColumn("cls", floors.class_of_pair(F.col("magnitude"), F.col("angle")))


@query(f"WITH {MONO} SELECT idx, part // 4 AS word, sum(cls * pow(8, 3 - part % 4))::BIGINT AS cls_word FROM classed GROUP BY idx, part // 4")
def q30_class_word(spark, sf_dir):
    return floors.class_word(_classes(spark, sf_dir), ("idx",), 8, 4)


LATTICE = [[a * 3 - 4, b * 3 - 4] for a in range(4) for b in range(4)]


@query(f"""WITH {PAIRS}, book AS (SELECT unnest(range(16))::INT AS e), d AS (
SELECT idx, bin, m, a, e, ((m - ((e // 4) * 3 - 4)) * (m - ((e // 4) * 3 - 4)) + (a - ((e % 4) * 3 - 4)) * (a - ((e % 4) * 3 - 4)))::BIGINT AS d FROM pairs, book),
r AS (SELECT *, row_number() OVER (PARTITION BY idx, bin ORDER BY d, e) AS k FROM d)
SELECT idx, bin, m, a, e AS entry, d AS distance FROM r WHERE k = 1""")
def q31_nearest_vq(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("n", floors.nearest(F.array("m", "a"), LATTICE))
    return rows.select("idx", "bin", "m", "a", F.col("n.e").alias("entry"), F.col("n.d").alias("distance"))


@query("""WITH used AS (SELECT unnest([3, 8, 21, 34, 55, 89]) AS u), d AS (
SELECT o_orderkey, u, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(u - o_orderkey % 97), u) AS k FROM (SELECT DISTINCT o_orderkey FROM orders), used)
SELECT o_orderkey, u::BIGINT AS entry FROM d WHERE k = 1""")
def q32_nearest_used(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return keys.withColumn("entry", floors.nearest_used(F.pmod("o_orderkey", F.lit(97)), [3, 8, 21, 34, 55, 89]))


# Entropy and containers --------------------------------------------------------------------------

LENGTHS = entropy.balanced_lengths(4096)


@query(f"""WITH {MONO}, words AS (SELECT idx, part // 4 AS word, sum(cls * pow(8, 3 - part % 4))::BIGINT AS w FROM classed GROUP BY idx, part // 4)
SELECT idx, sum(CASE WHEN w < {LENGTHS.count(min(LENGTHS)) if min(LENGTHS) < max(LENGTHS) else 0} THEN {min(LENGTHS)} ELSE {max(LENGTHS)} END)::BIGINT AS bits,
ceil(sum(CASE WHEN w < {LENGTHS.count(min(LENGTHS)) if min(LENGTHS) < max(LENGTHS) else 0} THEN {min(LENGTHS)} ELSE {max(LENGTHS)} END) / 8.0)::BIGINT AS bytes FROM words GROUP BY idx""")
def q33_bit_cost(spark, sf_dir):
    words = floors.class_word(_classes(spark, sf_dir), ("idx",), 8, 4)
    return entropy.bit_cost(words, LENGTHS, ("idx",), "cls_word")


@query(f"""WITH {SPEC}, low AS (SELECT idx, bin // 8 AS slot, min(coeff) AS m FROM spec GROUP BY idx, bin // 8),
wide AS (SELECT idx, slot * 8 + unnest(range(8)) AS bin, m FROM low)
SELECT idx, bin, m AS least FROM wide""")
def q34_reduce_repeat(spark, sf_dir):
    low = A.spectrum(spark, sf_dir).groupBy("idx", F.floor(F.col("bin") / 8).alias("slot")).agg(F.min("coeff").alias("least"))
    wide = low.withColumn("bin", F.explode(F.sequence(F.col("slot") * 8, F.col("slot") * 8 + 7)))
    return wide.select("idx", "bin", "least")


ACCOUNT = f"""{PACKETS}, numbered AS (SELECT *, seq > min(seq) OVER (PARTITION BY stream) AS audio, CASE WHEN mode = 1 THEN 2048 ELSE 256 END AS bs FROM packets),
stepped AS (SELECT *, CASE WHEN audio THEN (bs + lag(bs) OVER (PARTITION BY stream, audio ORDER BY seq)) // 4 END AS step FROM numbered),
sums AS (SELECT stream, sum(size + 2)::BIGINT AS data_size, max(CASE WHEN NOT audio THEN size END) + 2 AS first_audio_offset,
max(CASE WHEN audio THEN size END) AS max_packet, coalesce(sum(step), 0)::BIGINT AS rendered,
sum((audio AND mode = 0)::INT)::BIGINT AS short_blocks, sum((audio AND mode = 1)::INT)::BIGINT AS long_blocks FROM stepped GROUP BY stream),
account AS (SELECT *, greatest(rendered - 128, 1) AS frames FROM sums)"""


def _accounts(spark, sf_dir):
    frames = F.greatest(F.col("rendered") - 128, F.lit(1))
    return container.accounting(A.packets(spark, sf_dir), 48000, frames)


@query(f"""WITH {ACCOUNT} SELECT stream, data_size, first_audio_offset, max_packet, rendered, frames, greatest(0, rendered - frames) AS excess,
(data_size * 48000 // frames)::BIGINT AS average_bytes FROM account""")
def q35_packet_accounting(spark, sf_dir):
    return _accounts(spark, sf_dir).drop("short_blocks", "long_blocks")


@query(f"WITH {ACCOUNT} SELECT stream, frames, short_blocks, long_blocks, short_blocks + long_blocks AS blocks FROM account")
def q36_encode_stats(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    return a.select("stream", "frames", "short_blocks", "long_blocks", (F.col("short_blocks") + F.col("long_blocks")).alias("blocks"))


def _le(e: str, size: int) -> str:
    return " || ".join(f"lpad(hex((({e}) // {256**k}) % 256), 2, '0')" for k in range(size))


HEADER_VALUES = {
    "format_tag": "65535", "channels": "2", "sample_rate": "48000", "average_bytes": "data_size * 48000 // frames",
    "extra_size": "48", "total_frames": "frames", "first_audio_offset": "first_audio_offset", "data_size": "data_size",
    "excess_high": "greatest(0, rendered - frames) * 65536", "data_offset": "first_audio_offset",
    "max_packet": "coalesce(max_packet, 0)", "excess": "greatest(0, rendered - frames)", "short_power": "8", "long_power": "11",
}


@query(f"WITH {ACCOUNT} SELECT stream, {' || '.join(_le(HEADER_VALUES.get(n, '0'), s) for n, s in container.FIELDS)} AS header, data_size AS parsed_size, frames AS parsed_frames FROM account")
def q37_container_header(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    values = {n: F.expr(v.replace("//", "div")) for n, v in HEADER_VALUES.items()}
    rows = a.select("stream", container.pack_header(**values).alias("h"))
    rows = rows.withColumn("p", container.parse_header(F.col("h")))
    return rows.select(
        "stream", F.hex("h").alias("header"), F.col("p.data_size").alias("parsed_size"), F.col("p.total_frames").alias("parsed_frames")
    )


@query(f"""WITH {PACKETS}, p AS (SELECT stream, row_number() OVER w - 1 AS seq, size,
coalesce(sum(size + 2) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM packets WINDOW w AS (PARTITION BY stream ORDER BY seq))
SELECT stream, seq, position, size, NULL::VARCHAR AS error FROM p""")
def q38_packet_walk(spark, sf_dir):
    walked = container.walk_stream(container.build_stream(A.packets(spark, sf_dir)))
    return walked.select("stream", "seq", "position", F.octet_length("payload").cast("bigint").alias("size"), "error")


# Profiles and quality --------------------------------------------------------------------------


@query(f"""WITH known AS (SELECT * FROM (VALUES {', '.join(map(str, quality.PROFILES))}) AS t(profile, generation, channels, rate)),
wanted AS (SELECT n_nationkey AS id, 1 + n_nationkey % 2 AS generation, CASE n_regionkey WHEN 0 THEN 6 ELSE 2 END AS channels, CASE WHEN n_nationkey % 3 = 0 THEN 44100 ELSE 48000 END AS rate FROM nation)
SELECT id, generation, channels, rate, profile, CASE WHEN profile IS NULL THEN 'unsupported' END AS error FROM wanted LEFT JOIN known USING (generation, channels, rate)""")
def q39_profile_select(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    wanted = n.select(
        F.col("n_nationkey").alias("id"),
        (F.pmod("n_nationkey", F.lit(2)) + 1).cast("int").alias("generation"),
        F.when(F.col("n_regionkey") == 0, 6).otherwise(2).alias("channels"),
        F.when(F.pmod("n_nationkey", F.lit(3)) == 0, 44100).otherwise(48000).alias("rate"),
    )
    return quality.select_profile(wanted).select("id", "generation", "channels", "rate", "profile", "error")


@query(f"""WITH axis AS (SELECT * FROM (VALUES {', '.join(f'({i}, {b}::DOUBLE, {v}::DOUBLE)' for i, (b, v) in enumerate(zip(quality.BREAKPOINTS, quality.LOWPASS)))}) AS t(i, b, v)),
q AS (SELECT o_orderkey, CASE WHEN o_totalprice / 50000.0::DOUBLE / 10.0::DOUBLE + 1e-7::DOUBLE >= 1.0 THEN 0.9998999834060669::DOUBLE ELSE o_totalprice / 50000.0::DOUBLE / 10.0::DOUBLE + 1e-7::DOUBLE END AS q FROM (SELECT o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderkey))
SELECT o_orderkey, round(q, 9) AS share, round(a.v + (z.v - a.v) * ((q - a.b) / (z.b - a.b)), 5) AS lowpass, false AS extrapolated
FROM q JOIN axis a ON q >= a.b JOIN axis z ON z.i = a.i + 1 AND q < z.b""")
def q40_quality_interp(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max("o_totalprice").alias("p"))
    rows = o.withColumn("q", N.quality_share(F.col("p") / 50000.0)).withColumn("c", quality.interpolate(F.col("q")))
    return rows.select(
        "o_orderkey", F.round("q", 9).alias("share"), F.round("c.value", 5).alias("lowpass"), F.col("c.extrapolated").alias("extrapolated")
    )


@query(f"""WITH {FRAMES64}, pair AS (SELECT p.channel, p.sample / 32768.0::DOUBLE AS x, o.y FROM pcm p JOIN ola o ON o.channel = p.channel AND o.frame = p.frame
JOIN last l ON l.channel = p.channel WHERE p.frame >= 32 AND p.frame <= (l.m + 1) // 32 * 32 - 33)
SELECT channel, count(*) AS n, round(corr(x, y), 6) AS corr, round(sqrt(avg((x - y) * (x - y))), 6) + 0.0::DOUBLE AS rms, round(max(abs(x - y)), 6) + 0.0::DOUBLE AS peak FROM pair GROUP BY channel""")
def q41_quality_metrics(spark, sf_dir):
    pcm = A.pcm(spark, sf_dir).select("channel", "frame", N.domain(F.col("sample")).alias("x"))
    last = pcm.groupBy("channel").agg(F.max("frame").alias("m"))
    pairs = pcm.join(_resynthesis(spark, sf_dir), ["channel", "frame"]).join(F.broadcast(last), "channel")
    inner = F.col("frame").between(F.lit(32), F.floor((F.col("m") + 1) / 32) * 32 - 33)
    m = quality.metrics(pairs.where(inner), "x", "y", ("channel",))
    return m.select("channel", "n", F.round("corr", 6).alias("corr"), rounded("rms").alias("rms"), rounded("peak").alias("peak"))


@query(f"""WITH {RESIDUE}, other AS (SELECT idx, bin, floor(coeff / 0.0625::DOUBLE + 0.5::DOUBLE)::BIGINT AS q FROM spec WHERE (idx * 64 + bin) % 501 <> 500),
d AS (SELECT res.idx, res.bin, coalesce(res.q <> other.q, true) AS differs FROM res LEFT JOIN other ON res.idx = other.idx AND res.bin = other.bin)
SELECT idx, count(*) AS n, sum(differs::INT)::BIGINT AS different, min(CASE WHEN differs THEN bin END) AS first_bin FROM d GROUP BY idx""")
def q42_stage_diff(spark, sf_dir):
    other = A.spectrum(spark, sf_dir).where(F.pmod(F.col("idx") * 64 + F.col("bin"), F.lit(501)) != 500)
    other = other.select("idx", "bin", F.floor(F.col("coeff") / 0.0625 + 0.5).alias("q"))
    d = quality.first_difference(_residue(spark, sf_dir), other, ("idx", "bin"), "q", ("idx",))
    return d.select("idx", "n", "different", F.col("first.bin").alias("first_bin"))


@query(f"""WITH {PACKETS}, odd AS (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS before FROM packets WHERE (stream * 7 + seq) % 29 <> 0)
SELECT stream, seq, 'index is not contiguous' AS error FROM odd WHERE before IS NOT NULL AND seq <> before + 1""")
def q45_validation_report(spark, sf_dir):
    p = A.packets(spark, sf_dir).where(F.pmod(F.col("stream") * 7 + F.col("seq"), F.lit(29)) != 0)
    return quality.plan_errors(schedule.plan(p.select("stream", "seq", "mode")))


@query(f"""WITH {PCM} SELECT channel, frame // 512 AS block, round(sqrt(avg(sample::DOUBLE * sample)), 6) AS rms FROM pcm GROUP BY channel, frame // 512""")
def q46_rms_envelope(spark, sf_dir):
    return quality.rms_envelope(A.pcm(spark, sf_dir), 512).select("channel", "block", F.round("rms", 6).alias("rms"))


@query("""WITH d AS (SELECT l_linenumber, l_quantity::INT AS n, (l_extendedprice::BIGINT % 4294967296) AS word FROM lineitem)
SELECT l_linenumber, count(*) AS n, sum(CASE WHEN n <= 0 THEN 0 ELSE length(bin(n)) END)::BIGINT AS widths,
sum(CASE WHEN (word // 65536) % 65536 >= 32768 THEN (word // 65536) % 65536 - 65536 ELSE (word // 65536) % 65536 END)::BIGINT AS highs,
sum(word % 65536)::BIGINT AS lows FROM (SELECT l_linenumber, n, (floor(l_extendedprice)::BIGINT * 40503) % 4294967296 AS word FROM (SELECT l_linenumber, floor(l_quantity)::INT AS n, l_extendedprice FROM lineitem)) GROUP BY l_linenumber""")
def q47_bit_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        F.floor("l_quantity").cast("int").alias("k"),
        F.pmod(F.floor("l_extendedprice") * 40503, F.lit(4294967296)).alias("word"),
    )
    return rows.groupBy("l_linenumber").agg(
        F.count("*").alias("n"),
        F.sum(N.bit_width(F.col("k")).cast("bigint")).alias("widths"),
        F.sum(N.high16(F.col("word"))).alias("highs"),
        F.sum(N.low16(F.col("word"))).alias("lows"),
    )


@query(f"""WITH {PAIRS}, s AS (SELECT *, 0.94::DOUBLE * list_max([abs(m), abs(a)]) AS big, 0.94::DOUBLE * list_min([abs(m), abs(a)]) AS small,
CASE WHEN abs(m) > abs(a) OR (sign(m) = sign(a)) THEN sign(m) ELSE sign(a) END AS side, m * a > 0 OR (m <= 0 AND a < 0) OR (m < 0 AND a <= 0 AND a <> 0) AS together FROM pairs)
SELECT idx, bin, round(CASE WHEN together THEN (big + small) * CASE WHEN m > 0 THEN 1 ELSE -1 END WHEN m = 0 AND a = 0 THEN 0 ELSE (big - 0.18::DOUBLE * small) * side END, 6) + 0.0::DOUBLE AS strength, m + a AS "left", m - a AS "right" FROM s""")
def q48_pair_strength(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    side = C.mid_side(F.col("m"), F.col("a"))
    strength = C.point_hypot(F.col("m").cast("double"), F.col("a").cast("double"), 0.18)
    return rows.select("idx", "bin", rounded(strength).alias("strength"), side["left"].alias("left"), side["right"].alias("right"))


# Streams ---------------------------------------------------------------------------------------


def _chunks(spark, sf_dir, size: int) -> str:
    """User signals cut into chunks of ``size`` samples, written for a stream to read."""
    from pyspark.sql.window import Window as W

    rows = A.user_signal(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("stream").orderBy("i")) - 1)
    rows = rows.withColumn("seq", F.floor(F.col("k") / size))
    parts = F.array_sort(F.collect_list(F.struct("k", (F.col("sample") / 32768.0).alias("s"))))
    chunks = rows.groupBy("stream", "seq").agg(F.transform(parts, lambda e: e["s"]).alias("samples"))
    path = scratch(spark, "chunks")
    # All chunks of a stream in one file, as chunks of a trigger may come in any order but those of later files come later.
    chunks.withColumn("eos", F.lit(False)).select("stream", "seq", "samples", "eos").repartition("stream").write.parquet(path)
    return path


@query(f"""WITH {PCM}, k AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, sample FROM pcm),
n AS (SELECT stream, count(*) AS n FROM k GROUP BY stream),
f AS (SELECT stream, k, k // 16 - d AS q, sample, n FROM k JOIN n USING (stream), (SELECT unnest([0, 1]) AS d) WHERE k // 16 - d >= 0)
SELECT stream, q, (k - q * 16)::INT AS pos, sample FROM f WHERE q * 16 + 32 <= n""")
def q43_streaming_frames(spark, sf_dir):
    chunks = spark.readStream.schema(overlap.CHUNKS).parquet(_chunks(spark, sf_dir, 10))
    frames = overlap.run_once(overlap.sliding_frames(chunks, 32, 16), scratch(spark, "frames"), scratch(spark, "log"))
    each = frames.select("stream", "q", F.posexplode("samples").alias("pos", "x"))
    return each.select("stream", "q", "pos", (F.col("x") * 32768.0).cast("int").alias("sample"))


@query(f"""WITH {PCM}, k AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, sample FROM pcm)
SELECT stream, k AS place, sample FROM k""")
def q44_streaming_overlap_add(spark, sf_dir):
    chunks = spark.readStream.schema(overlap.CHUNKS).parquet(_chunks(spark, sf_dir, 16))
    done = overlap.run_once(overlap.overlap_add(chunks, 16), scratch(spark, "pcm"), scratch(spark, "log"))
    each = done.select("stream", "start", F.posexplode("samples").alias("pos", "x"))
    return each.select("stream", (F.col("start") + F.col("pos")).alias("place"), (F.col("x") * 32768.0).cast("int").alias("sample"))


# Codec -----------------------------------------------------------------------------------------


def _as_stream(spark, sf_dir):
    return A.pcm(spark, sf_dir).select(F.lit(0).cast("bigint").alias("stream"), "channel", "frame", "sample")


#: Residues so fine that decoding and rounding gives every sample back.
FINE = 65536.0


@query(f"WITH {PCM} SELECT channel, frame, sample FROM pcm")
def q49_codec_round_trip(spark, sf_dir):
    """Every sample through windows, transforms, packets and overlap-add, and back."""
    back = codec.decode(codec.encode(_as_stream(spark, sf_dir), 2, steps=FINE, least=0), 2, steps=FINE)
    return back.select("channel", "frame", N.half_away(F.col("x") * 32768.0).cast("int").alias("sample"))


@query(f"""WITH {PCM}, e AS (SELECT channel, frame // 64 AS q, sum((sample / 32768.0::DOUBLE) * (sample / 32768.0::DOUBLE)) AS e FROM pcm GROUP BY channel, frame // 64),
r AS (SELECT q, coalesce(e > 16 * avg(e) OVER (PARTITION BY channel ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) + 1e-4::DOUBLE, false)::INT AS r FROM e)
SELECT 0::BIGINT AS stream, q, max(r) AS slot FROM r GROUP BY q""")
def q50_transient_slots(spark, sf_dir):
    return codec.transient_slots(_as_stream(spark, sf_dir))


# Posts and identifiers -------------------------------------------------------------------------

POST_X = [0, 63, 16, 48, 32, 8, 24, 40, 56]


PLACES = "(VALUES " + ", ".join(f"({k + 1}, {x})" for k, x in enumerate(POST_X)) + ") AS p(k, x)"


def _guess(k: int) -> str:
    """SQL for the line below post ``k`` (from 0) between its nearest earlier posts."""
    low, high = posts.neighbours(POST_X)[k - 2]
    a, b, x0, x1 = f"y[{low + 1}]", f"y[{high + 1}]", POST_X[low], POST_X[high]
    return f"({a} + sign({b} - {a}) * (abs({b} - {a}) * {POST_X[k] - x0} // {x1 - x0}))::BIGINT"


STORED = ", ".join(["y[1]", "y[2]", *(f"stored(y[{k + 1}] - {_guess(k)}, {_guess(k)})" for k in range(2, len(POST_X)))])
for _k in range(2, len(POST_X)):
    _off, _g = f"(y[{_k + 1}] - {_guess(_k)})", _guess(_k)
    STORED = STORED.replace(
        f"stored(y[{_k + 1}] - {_g}, {_g})",
        f"CASE WHEN {_off} >= 0 AND {_off} < least(256 - {_g}, {_g}) THEN 2 * {_off} WHEN {_off} < 0 AND -{_off} <= least(256 - {_g}, {_g}) THEN -2 * {_off} - 1 "
        f"ELSE abs({_off}) + least(256 - {_g}, {_g}) - ({_off} < 0)::INT END",
    )


@query(f"""WITH {LEVELS}, rows2 AS (SELECT idx, list(level // 4 ORDER BY k) AS y FROM levels JOIN {PLACES} ON bin = x GROUP BY idx),
kept AS (SELECT idx, y, [{STORED}] AS stored FROM rows2)
SELECT idx, unnest(range({len(POST_X)}))::INT AS k, unnest(y)::INT AS height, unnest(stored)::INT AS stored FROM kept""")
def q51_floor_wrap(spark, sf_dir):
    """Stored residuals, and the heights that come back from them."""
    level = lambda k: N.multiplier_level(N.level(N.db(F.element_at("x", k + 1))), F.lit(1)).cast("int")
    rows = _rows64(spark, sf_dir).select("idx", F.array(*(level(k) for k in POST_X)).alias("y"))
    rows = rows.withColumn("stored", posts.wrapped(F.col("y"), POST_X, 256))
    rows = rows.withColumn("back", posts.wrapped(F.col("stored"), POST_X, 256, True))
    each = rows.select("idx", F.posexplode(F.arrays_zip(F.col("back").alias("height"), "stored")).alias("k", "p"))
    return each.select("idx", "k", "p.height", "p.stored")


@query(f"""WITH {ACCUMULATED}, s AS (SELECT idx, part, (n_a + n_b)::DOUBLE AS n, (sx_a + sx_b)::DOUBLE AS sx, (sy_a + sy_b)::DOUBLE AS sy, (sxx_a + sxx_b)::DOUBLE AS sxx, (sxy_a + sxy_b)::DOUBLE AS sxy FROM moments),
f AS (SELECT idx, part, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope, n, sx, sy FROM s),
e AS (SELECT l.idx, l.part, l.level - greatest(0, least(1023, floor((sy - slope * sx) / n + slope * l.bin + 0.5::DOUBLE)))::BIGINT AS d FROM near l JOIN f ON f.idx = l.idx AND f.part = l.part),
a AS (SELECT idx, part, max(d) AS "over", max(-d) AS under, (sum(d * d)::BIGINT // count(*)) AS square FROM e GROUP BY idx, part)
SELECT idx, part, "over", under, square, "over" > 60 OR under > 30 OR square > 500 AS split FROM a""")
def q52_line_errors(spark, sf_dir):
    m = _moments(spark, sf_dir)
    both = [(F.col(f"{c}_a") + F.col(f"{c}_b")).cast("double") for c in ("n", "sx", "sy", "sxx", "sxy")]
    lines = m.select("idx", "part", *(c.alias(n) for c, n in zip(both, ("n", "sx", "sy", "sxx", "sxy"))))
    rows = _levels(spark, sf_dir).withColumn("part", F.floor(F.col("bin") / 16)).join(lines, ["idx", "part"])
    fit = floors.line_fit(*map(F.col, ("n", "sx", "sy", "sxx", "sxy")), F.col("bin")).cast("bigint")
    return posts.line_errors(rows.withColumn("fit", fit), ("idx", "part"), "bin", "level")


@query(f"""WITH {SPEC} SELECT idx, round((list_extract(list(coeff ORDER BY bin), 1) ** 2 + 0.7::DOUBLE * list_extract(list(coeff ORDER BY bin), 2) ** 2
+ 0.2::DOUBLE * list_extract(list(coeff ORDER BY bin), 3) ** 2)::FLOAT::DOUBLE, 6) AS low FROM spec GROUP BY idx""")
def q53_low_energy(spark, sf_dir):
    return A.spectrum_rows(spark, sf_dir).select("idx", F.round(posts.low_energy(F.col("x")), 6).alias("low"))


@query("""SELECT p_partkey, p_partkey % 598 AS book, CASE WHEN p_partkey % 598 < 97 THEN 't97' WHEN p_partkey % 598 < 316 THEN 't219' ELSE 't282' END AS book_table,
CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 7 END AS error FROM part""")
def q54_identifiers(spark, sf_dir):
    book = F.pmod("p_partkey", F.lit(598))
    kind = F.element_at(F.array(*map(F.lit, ("malformed", "unsupported", "truncated", "whatever"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", book.alias("book"), posts.book_table(book).alias("book_table"), posts.error_class(kind).alias("error")
    )


# Histories, overrides, files -------------------------------------------------------------------

ENERGY = f"{PCM}, en AS (SELECT user_id AS stream, event_id AS i, (sample / 32768.0::DOUBLE) * (sample / 32768.0::DOUBLE) AS e FROM pcm)"


def _energies(spark, sf_dir):
    x = F.col("sample") / 32768.0
    return A.user_signal(spark, sf_dir).select("stream", "i", (x * x).alias("e"))


@query(f"""WITH {ENERGY} SELECT stream, i, coalesce(min(e) OVER w, 0.0::DOUBLE) AS low, coalesce(max(e) OVER w, 0.0::DOUBLE) AS high FROM en
WINDOW w AS (PARTITION BY stream ORDER BY i ROWS BETWEEN 7 PRECEDING AND 2 PRECEDING)""")
def q55_band_history(spark, sf_dir):
    return schedule.band_history(_energies(spark, sf_dir), 6).drop("e")


@query(f"""WITH {ENERGY} SELECT stream, i, round(sum(e) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) / 16, 9) + 0.0::DOUBLE AS mean FROM en""")
def q56_moving_mean(spark, sf_dir):
    return schedule.moving_mean(_energies(spark, sf_dir)).select("stream", "i", rounded("mean", 9).alias("mean"))


FIELD = f"[{', '.join(repr(f) for f in quality.SCALARS)}]"


@query(f"""WITH curves AS (SELECT c_nationkey AS profile, list_extract({FIELD}, (c_nationkey % 9 + 1)::INT) AS field, max(c_acctbal) AS v FROM customer GROUP BY c_nationkey),
scalars AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in quality.SCALARS.items())}) AS t(field, value))
SELECT p.profile, s.field, coalesce(c.v::FLOAT::DOUBLE, s.value) AS value FROM (SELECT DISTINCT profile FROM curves) p, scalars s LEFT JOIN curves c ON c.profile = p.profile AND c.field = s.field""")
def q57_override(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(f"short.{f}") for f in quality.SCALARS)), (F.pmod("c_nationkey", F.lit(9)) + 1).cast("int"))
    curves = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("profile"), name.alias("curve")).agg(F.max("c_acctbal").alias("value"))
    return quality.override(curves)


RECORDS = [[float(r * 10 + k) for k in range(6)] for r in range(5)]


@query("""WITH p AS (SELECT p_partkey, p_retailprice % 4 AS x FROM part), f AS (SELECT p_partkey, x, floor(x) AS r FROM p)
SELECT p_partkey, round(r * 10 + (x - r) * 10, 6) AS first, round(r * 10 + 3 + (x - r) * 10, 6) AS fourth, round(r * 10 + 5, 6) AS sixth FROM f""")
def q58_pick_record(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_retailprice", F.lit(4.0)).alias("x"))
    rows = rows.withColumn("r", quality.pick_record(F.col("x"), RECORDS))
    return rows.select("p_partkey", *(F.round(F.element_at("r", k), 6).alias(n) for k, n in ((1, "first"), (4, "fourth"), (6, "sixth"))))


@query(f"""WITH {ACCOUNT} SELECT stream, data_size + 66 + 28 AS size, data_size AS parsed_size, (SELECT count(*) FROM packets p WHERE p.stream = account.stream) AS packets, true AS same FROM account""")
def q59_container_file(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    values = {n: F.expr(v.replace("//", "div")) for n, v in HEADER_VALUES.items()}
    heads = a.select("stream", container.pack_header(**values).alias("header"))
    streams = container.build_stream(A.packets(spark, sf_dir)).join(heads, "stream")
    files = container.build_container(streams)
    loaded = container.load_container(files)
    walked = container.walk_stream(loaded).groupBy("stream").agg(F.count("payload").alias("packets"))
    same = container.compare_bytes(files, container.build_container(loaded.select("stream", "header", "body")), "stream")
    size = files.select("stream", F.octet_length("file").cast("bigint").alias("size"))
    parsed = loaded.select("stream", container.parse_header(F.col("header")).getField("data_size").alias("parsed_size"))
    return size.join(parsed, "stream").join(walked, "stream").join(same.select("stream", "same"), "stream")


@query()
def q60_floor_fit(spark, sf_dir):
    rows = _rows64(spark, sf_dir)
    rows = rows.select("idx", posts.fitted(F.transform("x", lambda c: N.level(N.db(c))), POST_X).alias("f"))
    return rows.select("idx", "f.heights", "f.needed")


# Queries of other modules register themselves.
from wavemill.plans import catalog_masking, catalog_packets  # noqa: E402, F401
