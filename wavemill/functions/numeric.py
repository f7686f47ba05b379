"""Exact scalar rules on columns: rounding seams, sample formats, quantizers. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x: Column) -> Column:
    """Round a double to single precision and back."""
    return x.cast("float").cast("double")


def half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint")


def half_even(x: Column) -> Column:
    """Nearest integer, halves to even."""
    low = F.floor(x)
    rest = x - low
    up = (rest > 0.5) | ((rest == 0.5) & (F.pmod(low, F.lit(2)) == 1))
    return (low + up.cast("int")).cast("bigint")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_int16(x: Column) -> Column:
    """A sample in -1..1 as 16 bits, halves away from zero, saturating; refuses NaN and infinities."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = F.greatest(F.lit(-40000.0), F.least(F.lit(40000.0), x * 32768.0))
    return F.when(bad, F.raise_error(F.lit("sample is not finite"))).otherwise(clamp(half_away(scaled), -32768, 32767)).cast("int")


def int24_to_int16(s: Column) -> Column:
    """24 bits to 16, halves away from zero, saturating."""
    up = F.shiftright(s + 128, 8)
    down = -F.shiftright(-s + 128, 8)
    return clamp(F.when(s >= 0, up).otherwise(down), -32768, 32767).cast("int")


def domain(s: Column) -> Column:
    """A 16-bit sample as -1..1."""
    return s / 32768.0


def in_domain(x: Column) -> Column:
    """Whether a value is a 16-bit sample exactly."""
    y = x * 32768.0
    return (y == F.floor(y)) & y.between(-32768.0, 32767.0)


def trunc_div(a: Column, b: Column | int) -> Column:
    """Integer quotient toward zero, as machine division gives it."""
    b = F.lit(b) if isinstance(b, int) else b
    q = F.floor(F.abs(a) / F.abs(b))
    return (F.signum(a) * F.signum(b) * q).cast("bigint")


def bit_width(n: Column) -> Column:
    """Bits needed to hold ``n``; none for 0."""
    return F.when(n <= 0, 0).otherwise(F.length(F.bin(n))).cast("int")


def db(x: Column) -> Column:
    """Level in decibels; -200 for nothing."""
    return F.when(x == 0, -200.0).otherwise(20.0 * F.log10(F.abs(x)))


#: Fixed value: steps per decibel of the 10-bit level scale, 1024 / 140 in single precision.
LEVELS_PER_DB = 7.314285755157471


def level(db_: Column) -> Column:
    """The 10-bit level of a value in decibels."""
    y = F.greatest(F.lit(-1e6), F.least(F.lit(1e6), db_ * LEVELS_PER_DB + 1023.5))
    return clamp((F.signum(y) * F.floor(F.abs(y))).cast("bigint"), 0, 1023).cast("int")


def level_amplitude(i: Column) -> Column:
    """The amplitude of one of 256 floor levels: seven decades, ending at 1."""
    return F.pow(F.lit(10.0), (i - 255) * (7.0 / 256.0))


def multiplier_level(y: Column, multiplier: Column) -> Column:
    """A 10-bit level on the grid of a floor multiplier 1..4; the unused-post flag 0x8000 stays."""
    low = y.bitwiseAND(F.lit(0x7FFF))
    grid = (
        F.when(multiplier == 1, F.shiftright(low, 2))
        .when(multiplier == 2, F.shiftright(low, 3))
        .when(multiplier == 3, F.floor(low / 12).cast("int"))
        .otherwise(F.shiftright(low, 4))
    )
    return grid.bitwiseOR(y.bitwiseAND(F.lit(0x8000)))


def multiplier_range(multiplier: Column) -> Column:
    """How many levels a floor multiplier has."""
    return F.element_at(F.array(*(F.lit(n) for n in (256, 128, 86, 64))), multiplier)


def packed_float(word: Column) -> Column:
    """A 32-bit packed float: sign, 10 bits of exponent biased by 788, 21 bits of mantissa."""
    mantissa = word.bitwiseAND(F.lit(0x1FFFFF)).cast("double")
    sign = F.when(F.shiftright(word, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power = F.shiftright(word, 21).bitwiseAND(F.lit(0x3FF)) - 788
    return sign * mantissa * F.pow(F.lit(2.0), power.cast("double"))


def high16(word: Column) -> Column:
    """The signed high half of a packed interval."""
    high = F.shiftright(word, 16).bitwiseAND(F.lit(0xFFFF))
    return F.when(high >= 0x8000, high - 0x10000).otherwise(high)


def low16(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFF))


def line_point(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """Integer height at ``x`` of the line between two posts, as the step-by-step walk gives it."""
    rise = y1 - y0
    off = F.floor(F.abs(rise) * (x - x0) / (x1 - x0))
    return (y0 + F.signum(rise) * off).cast("bigint")


def half_window(i: Column, n: int) -> Column:
    """The rising half of a power-complementary window of ``n`` places."""
    half_pi = 1.5707963267948966
    s = F.sin((i + 0.5) * (half_pi / n))
    return F.sin(s * s * half_pi)


def quality_share(q: Column) -> Column:
    """A 0..10 quality as a share; 1 and beyond stop just below."""
    x = q / 10.0 + 1e-7
    return F.when(x >= 1.0, 0.9998999834060669).otherwise(x)


def band_carry(c: Column, half_window_: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, c - (half_window_ - 2)))


def block_size(power: Column) -> Column:
    return F.when((power < 0) | (power >= 63), F.raise_error(F.lit("block size is malformed"))).otherwise(
        F.pow(F.lit(2.0), power).cast("bigint")
    )
