"""Channel coupling on pairs of columns; each returns a struct of two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def couple(m: Column, a: Column) -> Column:
    """The stored pair from which ``uncouple`` recovers (m, a)."""
    stored_m = F.when(m > 0, F.greatest(m, a)).otherwise(F.least(m, a))
    stored_a = F.when(m > 0, m - a).otherwise(a - m)
    return F.struct(stored_m.alias("m"), stored_a.alias("a"))


def uncouple(m: Column, a: Column) -> Column:
    """The pair before coupling: the angle moves one side away from the magnitude."""
    moved = F.when(m > 0, m - F.abs(a)).otherwise(m + F.abs(a))
    return F.struct(F.when(a > 0, m).otherwise(moved).alias("m"), F.when(a > 0, moved).otherwise(m).alias("a"))


def couple_lossless(first: Column, second: Column) -> Column:
    """Larger magnitude first; both signs flip where the angle is twice the magnitude or more."""
    wins = F.abs(first) > F.abs(second)
    m = F.when(wins, first).otherwise(second)
    a = F.when(m > 0, first - second).otherwise(second - first)
    flip = F.when(a >= 2 * F.abs(m), -1).otherwise(1)
    return F.struct((m * flip).alias("m"), (a * flip).alias("a"))


def mid_side(m: Column, s: Column) -> Column:
    return F.struct((m + s).alias("left"), (m - s).alias("right"))


#: Fixed by the method: both sides count this much.
DAMPED = 0.94


def point_hypot(first: Column, second: Column, reversal: float) -> Column:
    """The signed strength of a pair: equal signs add up; else the stronger less its share of the weaker, with the stronger's sign."""
    a, b = F.abs(first) * DAMPED, F.abs(second) * DAMPED
    lead = F.when(a > b, first).otherwise(second)
    agree = (first > 0) == (second > 0)
    strength = F.when(agree, a + b).otherwise(F.greatest(a, b) - F.least(a, b) * reversal)
    return strength * F.signum(F.when(agree, F.when(first == 0, second).otherwise(first)).otherwise(lead))
