"""Floor posts as prediction residuals, the check of a fitted line, and identifiers of books, versions and errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed by the format: the most a curve may lie over or under a fitted line, and the most its mean square may be.
OVER, UNDER, SQUARE = 60, 30, 500
#: First identifier beyond each shared table of codebooks.
BOOK_TABLES = ((97, "t97"), (316, "t219"), (598, "t282"))
#: Our stable error classes by kind.
ERRORS = {"malformed": 1, "unsupported": 2, "ambiguous": 2, "truncated": 3, "range": 4, "ended": 5, "order": 6, "internal": 7}


def neighbours(posts: list[int]) -> list[tuple[int, int]]:
    """For each post after the first two, the nearest earlier ones below and above it."""
    out = []
    for i in range(2, len(posts)):
        low = max((j for j in range(i) if posts[j] < posts[i]), key=lambda j: posts[j])
        high = min((j for j in range(i) if posts[j] > posts[i]), key=lambda j: posts[j])
        out.append((low, high))
    return out


def point(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    off = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - off if y1 < y0 else y0 + off


def wrap(heights: list[int], posts: list[int], levels: int) -> list[int]:
    """What is stored of post heights: the first two as they are, the others by how far they are off the line below them."""
    out, known = list(heights[:2]), list(heights[:2])
    for i, (low, high) in enumerate(neighbours(posts), 2):
        guess = point(posts[low], known[low], posts[high], known[high], posts[i])
        up, down = levels - guess, guess
        off = heights[i] - guess
        room = min(up, down)
        if off >= 0:
            stored = 2 * off if off < room else off + down
        else:
            stored = -2 * off - 1 if -off <= room else -off + up - 1
        out.append(stored)
        known.append(heights[i])
    return out


def unwrap(stored: list[int], posts: list[int], levels: int) -> tuple[list[int], list[bool]]:
    """Heights, and which posts carry them: those stored as 0 lie on their line unless a later post leans on them."""
    known, used = list(stored[:2]), [True, True]
    for i, (low, high) in enumerate(neighbours(posts), 2):
        guess = point(posts[low], known[low], posts[high], known[high], posts[i])
        up, down, v = levels - guess, guess, stored[i]
        used.append(v != 0)
        if v:
            used[low] = used[high] = True
        room = 2 * min(up, down)
        if v >= room:
            known.append(guess + v - down if up > down else guess - v + up - 1)
        else:
            known.append(guess - (v + 1) // 2 if v & 1 else guess + v // 2)
    return known, used


def wrapped(heights: Column, posts: list[int], levels: int, back: bool = False) -> Column:
    """``wrap`` (or, with ``back``, ``unwrap``) of a column of arrays."""
    @pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda y: None if y is None else (unwrap(list(y), posts, levels)[0] if back else wrap(list(y), posts, levels)))

    return run(heights)


def line_errors(points: DataFrame, keys: tuple[str, ...], x: str = "x", y: str = "y", fit: str = "fit") -> DataFrame:
    """Whether a line must be split: some level too far over or under it, or too large a mean square."""
    off = F.col(y) - F.col(fit)
    out = points.groupBy(*keys).agg(
        F.max(off).alias("over"), F.max(-off).alias("under"), F.floor(F.sum(off * off) / F.count(x)).alias("square")
    )
    return out.withColumn("split", (F.col("over") > OVER) | (F.col("under") > UNDER) | (F.col("square") > SQUARE))


def book_table(book: Column) -> Column:
    """Which shared table a codebook identifier is in; one beyond all is refused."""
    out = F.when(book < 0, F.raise_error(F.lit("no such codebook")))
    for end, name in BOOK_TABLES:
        out = out.when(book < end, name)
    return out.otherwise(F.raise_error(F.lit("no such codebook")))


def error_class(kind: Column) -> Column:
    """The stable class of an error; an unknown kind is internal."""
    table = F.create_map(*(F.lit(v) for pair in ERRORS.items() for v in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(ERRORS["internal"]))


def band_sums(x: Column, weights: list[list[float]], offsets: list[int]) -> Column:
    """Weighted sums of bands of an array, each step in single precision."""
    single = lambda e: e.cast("float").cast("double")
    out = []
    for w, at in zip(weights, offsets):
        terms = F.zip_with(F.slice(x, at + 1, len(w)), F.array(*(F.lit(float(v)) for v in w)), lambda a, b: single(a * b))
        out.append(F.aggregate(terms, F.lit(0.0), lambda s, t: single(s + t)))
    return F.array(*out)


def low_energy(x: Column) -> Column:
    """Energy of the lowest three bins, the upper two with less weight."""
    e = lambda k: F.element_at(x, k) * F.element_at(x, k)
    return (e(1) + 0.7 * e(2) + 0.2 * e(3)).cast("float").cast("double")


def smooth(y: np.ndarray, half: int) -> np.ndarray:
    """A moving least-squares line of ``half`` places either way, taken at each place."""
    n = len(y)
    sums = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    x = np.arange(n, dtype=np.float64)
    low, high = np.maximum(0, np.arange(n) - half), np.minimum(n, np.arange(n) + half + 1)
    c, sx, sy, sxx, sxy = ((s := sums(v))[high] - s[low] for v in (np.ones(n), x, y, x * x, x * y))
    wide = c * sxx - sx * sx
    slope = np.divide(c * sxy - sx * sy, wide, out=np.zeros(n), where=wide != 0)
    return (sy - slope * sx) / c + slope * x


def fit(levels: np.ndarray, x: list[int]) -> list[tuple[int, bool]]:
    """Heights of posts at ``x`` for a curve of 10-bit levels, and whether each is needed.

    A line over the whole range first; then, post by post in packet order, the line between a post's
    neighbours is checked against the curve, and where it fails the post takes the curve's own least-squares height.
    """
    place = np.arange(len(levels), dtype=np.float64)

    def line(a: int, b: int) -> tuple[float, float]:
        u, v = place[a : b + 1], levels[a : b + 1].astype(np.float64)
        slope = ((u - u.mean()) * (v - v.mean())).sum() / max(((u - u.mean()) ** 2).sum(), 1e-9)
        return slope, v.mean() - slope * u.mean()

    at = lambda s, p: int(np.clip(np.floor(s[0] * p + s[1] + 0.5), 0, 1023))
    whole = line(x[0], x[1])
    out = [(at(whole, x[0]), True), (at(whole, x[1]), True)]
    for i, (low, high) in enumerate(neighbours(x), 2):
        a, b = x[low], x[high]
        guess = point(a, out[low][0], b, out[high][0], x[i])
        drawn = np.array([point(a, out[low][0], b, out[high][0], p) for p in range(a, b + 1)])
        off = levels[a : b + 1] - drawn
        if off.max() > OVER or -off.min() > UNDER or (off * off).sum() // len(off) > SQUARE:
            left, right = line(a, x[i]), line(x[i], b)
            out.append((int(np.clip((at(left, x[i]) + at(right, x[i])) // 2, 0, 1023)), True))
        else:
            out.append((guess, False))
    return out


def split_fit(levels: np.ndarray, x: list[int]) -> list[tuple[int, bool]]:
    """Heights of posts at ``x`` by recursive splits, and whether each is needed.

    A segment is one least-squares line. Where the curve strays too far from it, the segment is split at the post in it
    that comes first in packet order, and both halves are fitted anew. A post between two segments takes the mean of
    their ends; one inside a segment lies on its line and is not needed.
    """
    place = np.arange(len(levels), dtype=np.float64)
    ends: dict[int, list[int]] = {0: [], 1: []}

    def line(a: int, b: int) -> tuple[int, int]:
        u, v = place[a : b + 1], levels[a : b + 1].astype(np.float64)
        slope = ((u - u.mean()) * (v - v.mean())).sum() / max(((u - u.mean()) ** 2).sum(), 1e-9)
        return tuple(int(np.clip(np.floor(v.mean() + slope * (p - u.mean()) + 0.5), 0, 1023)) for p in (a, b))

    todo = [(0, 1, line(x[0], x[1]))]
    while todo:
        low, high, (y0, y1) = todo.pop()
        a, b = x[low], x[high]
        inner = [i for i in range(2, len(x)) if a < x[i] < b]
        drawn = np.array([point(a, y0, b, y1, p) for p in range(a, b + 1)]) if inner else levels[a : b + 1]
        off = levels[a : b + 1] - drawn
        if inner and (off.max() > OVER or -off.min() > UNDER or (off * off).sum() // len(off) > SQUARE):
            middle = inner[0]
            todo += [(low, middle, line(a, x[middle])), (middle, high, line(x[middle], b))]
        else:
            ends.setdefault(low, []).append(y0)
            ends.setdefault(high, []).append(y1)
    out: list[tuple[int, bool]] = []
    near = neighbours(x)
    for i in range(len(x)):
        if i in ends:
            out.append((sum(ends[i]) // len(ends[i]), True))
        else:
            low, high = near[i - 2]
            out.append((point(x[low], out[low][0], x[high], out[high][0], x[i]), False))
    return out


def fitted(levels: Column, x: list[int]) -> Column:
    """``fit`` of a column of arrays: a struct of heights and needed flags."""
    @pandas_udf("heights array<int>, needed array<boolean>")
    def run(rows: pd.Series) -> pd.DataFrame:
        done = [fit(np.asarray(r), x) for r in rows]
        return pd.DataFrame({"heights": [[h for h, _ in d] for d in done], "needed": [[n for _, n in d] for d in done]})

    return run(levels)
