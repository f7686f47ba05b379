"""Profiles, quality curves, reconstruction metrics and differences of two pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import numeric as N

#: Our own profiles: (profile, generation, channels, sample rate).
PROFILES = (
    ("g1-2ch-44100", 1, 2, 44100), ("g1-2ch-48000", 1, 2, 48000), ("g1-6ch-44100", 1, 6, 44100), ("g2-2ch-48000", 2, 2, 48000),
)
#: Quality axis: 13 points from -0.2 to 1.0, a tenth apart; and our own low-pass curve over it.
BREAKPOINTS = tuple(round(-0.2 + 0.1 * i, 1) for i in range(13))
LOWPASS = tuple(8000.0 + 1000.0 * i for i in range(13))


def select_profile(wanted: DataFrame, keys: tuple[str, ...] = ("generation", "channels", "rate")) -> DataFrame:
    """``wanted`` with its only profile; ``error`` where none or several match."""
    spark = wanted.sparkSession
    known = spark.createDataFrame(list(PROFILES), "profile string, generation int, channels int, rate int")
    counted = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("profile").alias("profile"))
    rows = wanted.join(F.broadcast(counted), list(keys), "left")  # a handful of profiles
    n = F.coalesce("_n", F.lit(0))
    return (
        rows.withColumn("error", F.when(n == 0, "unsupported").when(n > 1, "ambiguous"))
        .withColumn("profile", F.when(n == 1, F.col("profile")))
        .drop("_n")
    )


def interpolate(quality: Column, curve: tuple[float, ...] = LOWPASS, axis: tuple[float, ...] = BREAKPOINTS) -> Column:
    """(value, extrapolated): the curve at a quality share, linear between points; beyond the last, just short of it."""
    n = len(axis)
    place = F.lit(0.0)
    for i in range(1, n):
        place = F.when(quality >= axis[i - 1], i - 1 + (quality - axis[i - 1]) / (axis[i] - axis[i - 1])).otherwise(place)
    place = F.when(quality >= axis[-1], n - 1 - 0.001).otherwise(place)
    low = F.floor(place).cast("int")
    points = F.array(*(F.lit(float(v)) for v in curve))
    a, b = F.element_at(points, low + 1), F.element_at(points, low + 2)
    return F.struct((a + (b - a) * (place - low)).alias("value"), ((quality < axis[0]) | (quality >= axis[-1])).alias("extrapolated"))


def metrics(pairs: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """n, corr, rms error and peak error of two aligned signals."""
    d = F.col(x) - F.col(y)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("peak")
    )


def rms_envelope(samples: DataFrame, size: int, keys: tuple[str, ...] = ("channel",), at: str = "frame", value: str = "sample") -> DataFrame:
    v = F.col(value).cast("double")
    block = F.floor(F.col(at) / size).cast("bigint").alias("block")
    return samples.groupBy(*keys, block).agg(F.sqrt(F.avg(v * v)).alias("rms"))


def first_difference(a: DataFrame, b: DataFrame, order: tuple[str, ...], value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many places of two variants differ, and the first that does; a place missing on one side differs."""
    left = a.select(*order, F.col(value).alias("_a"), F.lit(1).alias("_l"))
    right = b.select(*order, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    both = left.join(right, list(order), "full")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    place = F.when(~same, F.struct(*order))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~same).alias("different"), F.min(place).alias("first"))


def plan_errors(plan: DataFrame, stream: str = "stream", at: str = "seq") -> DataFrame:
    """Blocks of a plan that break its rules: gaps in the index, neighbours' modes that disagree, extents out of order."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(stream).orderBy(at)
    rows = plan.withColumns({f"_{c}": F.lag(c).over(w) for c in (at, "mode", "following", "sample_start")})
    error = (
        F.when(F.col(f"_{at}").isNull(), None)
        .when(F.col(at) != F.col(f"_{at}") + 1, "index is not contiguous")
        .when(F.col("previous") != F.col("_mode"), "previous mode disagrees")
        .when(F.col("mode") != F.col("_following"), "following mode disagrees")
        .when(F.col("sample_start") <= F.col("_sample_start") - 2048, "extent goes back")
    )
    return rows.withColumn("error", error).where(F.col("error").isNotNull()).select(stream, at, "error")


#: Scalars of a profile that curves named ``short.<field>`` may override, with their values.
SCALARS = {"attack": 12.0, "release": 24.0, "bias": -140.0, "peak": -8.0, "tone": 0.5, "noise": 0.25, "limit": 90.0, "carry": 3.0, "gate": -6.0}
#: Our profile versions: code, label and generation.
VERSIONS = ((1, "first", 2013), (2, "second", 2019))


def override(curves: DataFrame, profile: str = "profile", curve: str = "curve", value: str = "value") -> DataFrame:
    """profile, field, value: each profile's scalars, those overridden by a curve in single precision. Unknown fields are refused."""
    spark = curves.sparkSession
    name = F.substring(F.col(curve), 7, 100)
    known = F.col(curve).startswith("short.") & name.isin(*SCALARS)
    field = F.when(known, name).otherwise(F.raise_error(F.concat(F.lit("no such field: "), F.col(curve))))
    given = curves.select(profile, field.alias("field"), N.f32(F.col(value)).alias("_v"))
    scalars = spark.createDataFrame(list(SCALARS.items()), "field string, value double")
    rows = curves.select(profile).distinct().join(F.broadcast(scalars))  # nine fields a profile
    rows = rows.join(given, [profile, "field"], "left")
    return rows.select(profile, "field", F.coalesce("_v", "value").alias("value"))


def pick_record(index: Column, records: list[list[float]], lerped: int = 4) -> Column:
    """The record at the whole part of ``index``; its first values move toward the next record's by the rest."""
    table = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in records))
    low = F.floor(index).cast("int")
    a, b = F.element_at(table, low + 1), F.element_at(table, F.least(low + 2, F.lit(len(records))))
    moved = F.zip_with(F.slice(a, 1, lerped), F.slice(b, 1, lerped), lambda x, y: x + (y - x) * (index - low))
    return F.concat(moved, F.slice(a, lerped + 1, len(records[0]) - lerped))


def version_code(spelling: Column) -> Column:
    """The code of a version given as its code, label or generation; null for any other."""
    text = F.lower(F.trim(spelling))
    out = F.lit(None).cast("int")
    for code, label, generation in VERSIONS:
        out = F.when(text.isin(str(code), label, str(generation)), code).otherwise(out)
    return out


def profile_label(generation: Column, channels: Column, rate: Column) -> Column:
    return F.format_string("g%d-%dch-%d", generation, channels, rate)


def profile_description(generation: Column, channels: Column, rate: Column, layout: Column) -> Column:
    """The label with what it leaves out: the order of the channels."""
    return F.concat_ws("-", profile_label(generation, channels, rate), layout)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles (profile, generation, channels, rate) from JSON lines or Parquet; missing or doubled fields and values that are no such number are refused."""
    reader = spark.read.schema("profile string, generation int, channels int, rate int").option("mode", "FAILFAST")
    rows = reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)
    whole = F.col("profile").isNotNull() & (F.col("generation") > 0) & (F.col("channels") > 0) & (F.col("rate") > 0)
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("profile")).otherwise(F.raise_error(F.lit("profile is malformed")))
    return rows.withColumn("profile", checked)
