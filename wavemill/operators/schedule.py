"""Block schedules and ordered counters, each in windows over one stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHORT, LONG = 256, 2048


#: Places of a stream that are ranked in one task; running values go over such parts in two levels.
PART = 1 << 16


def _order(stream: str, at: str) -> W:
    return W.partitionBy(stream).orderBy(at)


def _in_parts(rows: DataFrame, stream: str, at: str, part: int) -> tuple[DataFrame, W, W]:
    """``rows`` with the part of the order that each is in and its place there, and windows over what is before a row in its part and before a part.

    A running value over a stream is then one within the part and one over parts, a row each, so no task holds a stream.
    """
    rows = rows.withColumn("_part", F.floor(F.col(at) / part).cast("bigint"))
    own = W.partitionBy(stream, "_part").orderBy(at)
    rows = rows.withColumn("_k", F.row_number().over(own) - 1)
    return rows, own, W.partitionBy(stream).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def plan(modes: DataFrame, stream: str = "stream", at: str = "seq", short: int = SHORT, long: int = LONG) -> DataFrame:
    """previous, current, following, sample_start, sample_end, advance of each block (mode 1: long).

    A block begins half its length before its centre; centres lie a quarter of both
    neighbours' lengths apart, and the block after the last counts as long.
    """
    w = _order(stream, at)
    size = lambda mode: F.when(mode == 1, long).otherwise(short).cast("bigint")
    following = F.coalesce(F.lead("mode").over(w), F.lit(1))
    rows = modes.withColumn("following", following).withColumn("previous", F.coalesce(F.lag("mode").over(w), F.lit(0)))
    rows = rows.withColumn("advance", ((size(F.col("mode")) + size(F.col("following"))) / 4).cast("bigint"))
    base = F.coalesce(F.sum("advance").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("sample_start", (base + long // 2 - size(F.col("mode")) / 2).cast("bigint"))
    return rows.withColumn("sample_end", F.col("sample_start") + size(F.col("mode")))


def transient_queue(flags: DataFrame, stream: str = "stream", at: str = "i", flag: str = "flags") -> DataFrame:
    """``slot``: whether a quantum or a neighbour's overhang marks a transient."""
    w = _order(stream, at)
    bit = lambda x, m: F.coalesce(x.bitwiseAND(F.lit(m)), F.lit(0)) != 0
    slot = bit(F.col(flag), 3) | bit(F.lag(flag).over(w), 1) | bit(F.lead(flag).over(w), 2)
    return flags.withColumn("slot", slot.cast("int"))


def history_counter(flags: DataFrame, stream: str = "stream", at: str = "i", flag: str = "flags", most: int = 24, part: int = PART) -> DataFrame:
    """``history``: quanta since the last reset (flag 4) before this one, at most ``most``."""
    rows, own, before = _in_parts(flags, stream, at, part)
    reset = F.when(F.col(flag).bitwiseAND(F.lit(4)) != 0, F.col("_k"))
    rows = rows.withColumn("_in", F.max(reset).over(own.rowsBetween(W.unboundedPreceding, -1)))
    parts = rows.groupBy(stream, "_part").agg(F.count("*").alias("_c"), F.max(reset).alias("_r"))
    parts = parts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    parts = parts.select(stream, "_part", "_b", F.max(F.col("_r") + F.col("_b")).over(before).alias("_t"))
    n, last = F.col("_b") + F.col("_k"), F.greatest(F.col("_in") + F.col("_b"), F.col("_t"))
    count = F.when(last.isNull(), n).otherwise(n - last - 1)
    out = rows.join(parts, [stream, "_part"]).withColumn("history", F.least(F.lit(most), count).cast("int"))
    return out.select(*flags.columns, "history")


def transition_code(modes: DataFrame, stream: str = "stream", at: str = "seq") -> DataFrame:
    """``code``: mode in bit 1, and in bit 0 whether a long block follows a long one."""
    before = F.coalesce(F.lag("mode").over(_order(stream, at)), F.lit(0))
    variant = F.when((F.col("mode") == 1) & (before != 0), 1).otherwise(0)
    return modes.withColumn("code", variant.bitwiseOR(F.col("mode") * 2).cast("int"))


def transition_codes(plan: DataFrame, slots: DataFrame, stream: str = "stream", at: str = "seq", hop: int = 64, short: int = SHORT, long: int = LONG) -> DataFrame:
    """``code`` of each planned block: mode in bit 1; in bit 0 whether a long block has long neighbours, or a short one
    no transient (``slots``: stream, q, slot) within a quarter of its length and of a short block's of its centre.

    What follows the last block counts as long. Only short blocks are met with slots, by the few quanta that each reaches.
    """
    size = F.when(F.col("mode") == 1, long).otherwise(short)
    centre = F.col("sample_start") + size / 2 - long // 2
    reach = size / 4 + short // 4
    toward_zero = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")
    first, last = toward_zero((centre - reach) / hop), toward_zero((centre + reach) / hop) - 1
    near = plan.where((F.col("mode") == 0) & (last >= first)).select(stream, at, F.explode(F.sequence(first, last)).alias("q"))
    struck = near.join(slots.where("slot <> 0").select(stream, "q"), [stream, "q"]).select(stream, at).distinct().withColumn("_struck", F.lit(1))
    calm = F.when(F.col("_struck").isNull(), 1).otherwise(0)
    inside = ((F.col("previous") != 0) & (F.col("following") != 0)).cast("int")
    code = F.when(F.col("mode") == 1, inside + 2).otherwise(calm)
    return plan.join(struck, [stream, at], "left").withColumn("code", code.cast("int")).drop("_struck")


def runs(modes: DataFrame, stream: str = "stream", at: str = "seq", most: int = 8) -> DataFrame:
    """``run``: how many equal modes end here; ``tail``: the same, at most ``most``, 0 on a change."""
    w = _order(stream, at)
    change = (F.col("mode") != F.lag("mode").over(w)).cast("int")
    rows = modes.withColumn("_island", F.coalesce(F.sum(change).over(w), F.lit(0)))
    run = F.row_number().over(W.partitionBy(stream, "_island").orderBy(at))
    rows = rows.withColumn("run", run)
    return rows.withColumn("tail", F.least(F.lit(most), F.col("run") - 1)).drop("_island")


def leaky_peak(
    rows: DataFrame, decay: float, stream: str = "stream", at: str = "idx", value: str = "peak", carried: float | None = None, part: int = PART
) -> DataFrame:
    """``leaky``: a peak that sinks by ``decay`` a block until a higher one comes; ``carried`` is the peak before the first block."""
    placed, own, before = _in_parts(rows, stream, at, part)
    raised = F.col(value) + (F.col("_k") + 1) * F.lit(float(decay))
    placed = placed.withColumn("_in", F.max(raised).over(own))
    parts = placed.groupBy(stream, "_part").agg(F.count("*").alias("_c"), F.max(raised).alias("_m"))
    parts = parts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)) * F.lit(float(decay)))
    parts = parts.select(stream, "_part", "_b", F.max(F.col("_m") + F.col("_b")).over(before).alias("_t"))
    # Greatest skips nulls: there is no peak before the first part, nor a carried one unless it is given.
    top = F.greatest(F.col("_in") + F.col("_b"), F.col("_t"), F.lit(carried).cast("double"))
    out = placed.join(parts, [stream, "_part"]).withColumn("leaky", top - F.col("_b") - (F.col("_k") + 1) * F.lit(float(decay)))
    return out.select(*rows.columns, "leaky")


def prefix_sums(rows: DataFrame, values: dict[str, Column], stream: str = "idx", at: str = "bin") -> DataFrame:
    """Running sums of ``values`` over each row's bins."""
    w = _order(stream, at).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(v).over(w) for name, v in values.items()})


def band_history(rows: DataFrame, width: int, stream: str = "stream", at: str = "i", value: str = "e") -> DataFrame:
    """``low`` and ``high``: extremes of the last ``width`` values but the one just before; 0 where there is no history."""
    w = _order(stream, at).rowsBetween(-width - 1, -2)
    return rows.withColumn("low", F.coalesce(F.min(value).over(w), F.lit(0.0))).withColumn(
        "high", F.coalesce(F.max(value).over(w), F.lit(0.0))
    )


def moving_mean(rows: DataFrame, slots: int = 15, stream: str = "stream", at: str = "i", value: str = "e") -> DataFrame:
    """``mean``: the sum of the last ``slots`` values over ``slots`` + 1, as a ring that starts empty gives it."""
    w = _order(stream, at).rowsBetween(-slots + 1, 0)
    return rows.withColumn("mean", F.sum(value).over(w) / (slots + 1))
