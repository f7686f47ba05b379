"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear and
never negative. A source's documents are laid out in a fixed shuffled order (by
MD5 of their id), again and again, along the source's own token axis. Its
schedule, integrated and scaled to the source's target, is its cumulative token
demand; inverting that at a document's place on the axis gives the moment at which the
mix takes it. Documents are then range-sorted by that position.

A document is taken in pass k if the middle of its span lies below the target, so
each source's taken words miss its target by half a document at most, and as
targets stop at ``cap`` times a source, no document is taken more than
``cap`` times.

Everything is DataFrame expressions. Running sums over a source are taken in
three levels (``FAN`` ranges of the shuffled order, ``FAN`` in each of them, the rows of one), so no task holds a source: a source with a
third of all rows is spread over 4,096 ranges like any other. Sources themselves are a
dimension: one row each, ordered once in one task, so there may be as many as fit a task.

Defined cases: a null or blank text has size 0 and is never taken; a null source is
a source of its own, last in the order; rows with equal ids are ordered by the digest
of their text, and wholly equal rows are interchangeable; an empty table gives an empty
mix; other columns pass through ``mix`` untouched, but one of the name given to positions is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.llm.common import text_of, without
from wavemill.plans.runtime import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
#: Fixed by the contract: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges a level: three hex digits of the shuffled order, in two levels of 64.
FAN = 64
#: Weight over training time by place in the order of sources: (time, relative weight).
#: Heavy sources fade in, light ones fade out, the middle ones stay level.
SCHEDULES = (
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.75, 1.0), (1.0, 0.0)),
)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, size and the shuffled order of each row; with ``carry``, the whole row too."""
    rows = docs.select(
        docs[key].alias("doc_id"),
        docs[source].alias("source"),
        F.coalesce(F.concat(F.lit("="), docs[source]), F.lit("")).alias("sid"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(docs[key].cast("string"), F.lit(""))).alias("place"),
        F.crc32(text_of(docs[text])).alias("tie"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []),
    )
    at = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    return rows.withColumn("coarse", F.floor(at / FAN).cast("int")).withColumn("fine", F.pmod(at, F.lit(FAN)))


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sid, source_size, weight, nth, target: ``share`` times all words by weight, no source above ``cap`` times its own.

    Resharing the excess until no source is above its cap ends where all uncapped
    sources get the same words per weight. With the sources in order of cap
    per weight, that level is the first one which its own source can take in.
    """
    by_source = sums.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").cast("bigint").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("nth", F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("nth") + 1))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("most") / F.col("weight"))
    rising = W.orderBy("room", F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    spent = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    demand = F.lit(float(share)) * F.sum("source_size").over(everything)
    s = s.withColumn("level", (demand - spent) / F.sum("weight").over(rest)).withColumn("nr", F.row_number().over(rising))
    fits = F.col("level") <= F.col("room")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("nr"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.select("sid", "source_size", "weight", "nth", target.alias("target"), F.sum(target).over(everything).alias("demand"))


def moment(share: Column, schedule) -> Column:
    """The time at which a source has used ``share`` (0..1) of its demand: its integrated schedule, inverted."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    out, done = None, 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        w0, w1 = w0 / area, w1 / area
        slope, gain = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        over = share - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * over, F.lit(0.0)))
        here = F.lit(t0) + F.coalesce(F.try_divide(F.lit(2.0) * over, F.lit(w0) + root), F.lit(0.0))
        done += gain
        out = F.when(share < done, here) if out is None else out.when(share < done, here)
    return out.otherwise(F.lit(float(schedule[-1][0])))


def plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    schedules=SCHEDULES,
    share: float = SHARE,
    cap: int = CAP,
    carry: bool = False,
) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, and ``uses``, the (pass, position) at which the mix takes it."""
    ranges = ["sid", "coarse", "fine"]
    # Texts are read once for the plan alone; where whole rows go along, they are read again rather than written in between.
    rows = sized(docs, key, text, source, carry) if carry else cut(sized(docs, key, text, source), "mix-sizes")
    narrow = sized(docs, key, text, source) if carry else rows
    # At most FAN x FAN rows a source, summed before the shuffle.
    sums = narrow.groupBy(*ranges).agg(F.min("source").alias("source"), F.sum("size").alias("size"))
    sums = cut(sums, "mix-sums")
    below = W.partitionBy("sid", "coarse").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)
    fine = sums.select(*ranges, F.coalesce(F.sum("size").over(below), F.lit(0)).alias("fine_from"))
    lower = W.partitionBy("sid").orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)
    coarse = sums.groupBy("sid", "coarse").agg(F.sum("size").alias("size"))
    coarse = coarse.select("sid", "coarse", F.coalesce(F.sum("size").over(lower), F.lit(0)).alias("coarse_from"))
    goals = targets(sums, weights, share, cap)
    starts = fine.join(coarse, ["sid", "coarse"]).join(goals, "sid").withColumn("range_from", F.col("fine_from") + F.col("coarse_from"))
    within = W.partitionBy(*ranges).orderBy("place", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts.drop("fine_from", "coarse_from"), ranges)
    middle = lambda k: F.col("range_from") + F.col("inside") + k * F.col("source_size") + F.col("size") / 2.0
    passes = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: (F.col("size") > 0) & (middle(k) < F.col("target")))

    def position(k: Column) -> Column:
        part = middle(k) / F.col("target")
        at = None
        for n in range(len(weights)):
            t = moment(part, schedules[n % len(schedules)])
            at = F.when(F.col("nth") == n, t) if at is None else at.when(F.col("nth") == n, t)
        return at * F.col("demand")

    uses = F.transform(passes, lambda k: F.struct(k.alias("pass"), position(k).alias("position")))
    return rows.withColumn("uses", uses).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("uses")).cast("bigint").alias("taken"),
        "uses",
        *(["row"] if carry else []),
    )


def mix(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """The training stream: rows of ``docs``, repeated as the mix takes them, range-sorted by position.

    ``position`` names a column to add with the position in words.
    """
    used = plan(docs, carry=True, **options).select("row", "doc_id", F.explode("uses").alias("use"))
    used = used.orderBy("use.position", "doc_id", "use.pass")
    extra = [F.col("use.position").alias(position)] if position else []
    kept = without(docs, position).columns if position else docs.columns
    return used.select(*(F.col("row").getField(c).alias(c) for c in kept), *extra)
