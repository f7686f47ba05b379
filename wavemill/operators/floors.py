"""Piecewise-linear spectral floors and quantized residues as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import numeric as N

#: The greatest peak of each residue class, and a hundred times its mean bound (negative: none).
MONO_PEAK = (0, 1, 1, 2, 2, 4, 28)
MONO_MEAN = (-1, 25, -1, 45, -1, -1, -1)
#: The greatest magnitude and angle of each class of coupled residue.
PAIR_MAGNITUDE = (0, 1, 1, 2, 2, 4, 8, 16, 32)
PAIR_ANGLE = (0, 0, 999, 0, 999, 4, 8, 16, 32)


def accumulate(points: DataFrame, keys: tuple[str, ...], near: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Moments of the points of each interval in two buckets: those ``near`` the curve (a), and the others (b)."""
    parts = {"n": F.lit(1), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}
    sums = [
        F.coalesce(F.sum(F.when(near if b == "a" else ~near, v.cast("bigint"))), F.lit(0)).alias(f"{name}_{b}")
        for b in "ab"
        for name, v in parts.items()
    ]
    return points.groupBy(*keys).agg(*sums)


def line_fit(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, at: Column) -> Column:
    """The least-squares line at ``at``, to the nearest level 0..1023; null without a spread of points."""
    wide = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / F.nullif(wide, F.lit(0.0))
    start = (sy - slope * sx) / F.nullif(n, F.lit(0.0))
    return N.clamp(F.floor(start + slope * at + 0.5), 0, 1023).cast("int")


def neighbours(posts: DataFrame, at: str = "i", x: str = "x") -> DataFrame:
    """low, high: the nearest earlier post on either side of each post. Posts are a small dimension."""
    a, b = posts.alias("a"), posts.select(F.col(at).alias("j"), F.col(x).alias("xj")).alias("b")
    pairs = a.join(F.broadcast(b), F.col("j") < F.col(at), "left")
    return pairs.groupBy(at, x).agg(
        F.max(F.when(F.col("xj") < F.col(x), F.struct("xj", "j"))).getField("j").alias("low"),
        F.min(F.when(F.col("xj") > F.col(x), F.struct("xj", "j"))).getField("j").alias("high"),
    )


def residue(coeff: Column, floor: Column, eps: float = 1e-9) -> Column:
    """A coefficient over its floor, to the nearest integer, halves to even; 0 where there is no floor."""
    return F.when(F.abs(floor) < eps, F.lit(0)).otherwise(N.half_even(coeff / floor)).cast("bigint")


def class_of_mono(peak: Column, total: Column, count: Column) -> Column:
    """The first residue class whose peak and mean bounds hold."""
    mean = N.trunc_div(total * 100, count)
    out = None
    for k, (p, m) in enumerate(zip(MONO_PEAK, MONO_MEAN)):
        fits = (peak <= p) & (F.lit(True) if m < 0 else mean < m)
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out.otherwise(len(MONO_PEAK))


def class_of_pair(magnitude: Column, angle: Column, classes: int = 10) -> Column:
    out = None
    for k, (m, a) in enumerate(zip(PAIR_MAGNITUDE, PAIR_ANGLE)):
        fits = (magnitude <= m) & (angle <= a)
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out.otherwise(classes - 1)


def class_word(digits: DataFrame, keys: tuple[str, ...], classes: int, per_word: int, digit: str = "cls", at: str = "part") -> DataFrame:
    """word, cls_word: ``per_word`` successive classes as digits, first most; missing ones count 0."""
    place = F.pow(F.lit(float(classes)), F.lit(per_word - 1) - F.pmod(at, F.lit(per_word))).cast("bigint")
    word = F.floor(F.col(at) / per_word).cast("bigint")
    return digits.groupBy(*keys, word.alias("word")).agg(F.sum(F.col(digit) * place).alias("cls_word"))


def class_digits(word: Column, classes: int, per_word: int) -> Column:
    """The classes of a class word, the first first; the inverse of ``class_word``."""
    return F.transform(F.sequence(F.lit(per_word - 1), F.lit(0)), lambda k: F.pmod(F.floor(word / F.pow(F.lit(float(classes)), k)), F.lit(classes)).cast("int"))


def residue_row(spectrum: Column, floor: Column, eps: float = 1e-8) -> Column:
    """Coefficients over their floor, 0 where the floor is none; those past the floor's end stay as they are."""
    n = F.size(floor)
    over = F.zip_with(F.slice(spectrum, F.lit(1), n), floor, lambda m, f: F.when(F.abs(f) < eps, 0.0).otherwise(m / f))
    return F.concat(over, F.slice(spectrum, n + 1, F.greatest(F.size(spectrum) - n, F.lit(0))))


def partition_count(begin: Column, end: Column, n: Column, size: Column) -> Column:
    return N.trunc_div(F.least(end, n) - begin, size)


def nearest(point: Column, entries: list[list[int]]) -> Column:
    """(d, e): the codebook entry at the least squared distance of an array, the lowest on ties.

    A codebook is a constant, so each point is held against it inside one expression; no join.
    """
    book = F.array(*(F.struct(F.array(*(F.lit(v) for v in row)).alias("v"), F.lit(i).alias("e")) for i, row in enumerate(entries)))

    def distance(entry: Column) -> Column:
        parts = F.zip_with(point, entry["v"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, d: s + d)

    return F.array_min(F.transform(book, lambda e: F.struct(distance(e).alias("d"), e["e"].alias("e"))))


def nearest_used(value: Column, used: list[int]) -> Column:
    """The used value at the least distance, the lowest on ties."""
    one = F.array(*(F.lit(u).cast("bigint") for u in used))
    return F.array_min(F.transform(one, lambda u: F.struct(F.abs(u - value).alias("d"), u.alias("u")))).getField("u")
