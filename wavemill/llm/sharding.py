"""Sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots. Rows and bytes are summed per
slot, and a versioned slot-to-shard map says which shard a slot is in. Version 0
deals the slots out in turn; each rebalancing loads the last version, edits it and
appends the next: shards above their fair share of bytes give up slots, which go to the
shards with the least. Data move only with the slots that were edited, and no version is ever rewritten.

The map has ``SLOTS`` entries whatever the data, so it is edited on the driver and
broadcast. Rows get their place in a shard from the rows of the slots before
theirs in that shard plus their rank in their slot, so no task sorts a shard.

The law is ``bytes``: shard sizes are near equal. A slot holds whole records, so
shards differ by about one record when slots are small. Records are hashed by id
and text, so equal texts (a hot group of copies) spread over all slots; rows that are equal in both are counted
first and hashed by their number too, in runs of ``RUN``, so that they spread as well.

Defined cases: a null text has no bytes and the CRC of the empty string; null ids
hash as such; wholly equal rows are interchangeable and get different places; an
empty table gives an empty result and the map of version 0; other columns are
ignored by ``place_rows``. A stored map with another number of slots or with shards beyond those asked for is refused.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.llm.common import text_of
from wavemill.plans.runtime import cut, scratch

SLOTS, SHARDS = 16_384, 40
#: Bytes a record takes beyond its text.
OVERHEAD = 16
#: So many rows of one id and text share a slot.
RUN = 64
MAP = "version int, virtual_slot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: narrow rows, one scan of the texts."""
    rows = docs.select(
        docs[key].alias("doc_id"),
        (F.octet_length(text_of(docs[text])).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(text_of(docs[text])).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))).alias("run")
    rows = rows.select("*", runs)
    rows = rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "run"), F.lit(slots)).cast("int"))
    own = F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN).cast("int")
    return rows.select("doc_id", "size", "text_crc32", "virtual_slot", F.explode(F.array_repeat(F.lit(0), own))).drop("col")


def slot_sums(rows: DataFrame) -> DataFrame:
    """Rows and bytes per slot, combined before the shuffle; at most one row a slot."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(old: list[int], weight: list[int], shards: int = SHARDS) -> list[int]:
    """The next version: ``old`` with as many slots moved as it takes to even out ``weight``.

    Shards over their fair share give up their largest slots, which then go,
    largest first, to the lightest shard, and last single slots are moved or
    swapped between the heaviest and the lightest while that narrows the gap.
    """
    new, load, own = list(old), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        load[shard] += weight[slot]
        if weight[slot]:
            own[shard].append(slot)
    fair, loose = sum(load) / shards, []
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda s: (-weight[s], s)):
            if load[shard] - weight[slot] >= fair * 0.9 and load[shard] > fair:
                load[shard] -= weight[slot]
                own[shard].remove(slot)
                loose.append(slot)
    heap = [(x, i) for i, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        x, i = heapq.heappop(heap)
        own[i].append(slot)
        load[i] = x + weight[slot]
        heapq.heappush(heap, (load[i], i))
    for _ in range(20 * shards):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        give, take = _trade(own[high], own[low], weight, gap)
        if give is None:
            break
        own[high].remove(give)
        own[low].append(give)
        if take is not None:
            own[low].remove(take)
            own[high].append(take)
        moved = weight[give] - (weight[take] if take is not None else 0)
        load[high] -= moved
        load[low] += moved
    for shard in range(shards):
        for slot in own[shard]:
            new[slot] = shard
    return new


def _trade(high: list[int], low: list[int], weight: list[int], gap: int) -> tuple[int | None, int | None]:
    """The slot to give, and the one to take back for it if any, that come nearest to half the gap."""
    back = sorted(((weight[s], s) for s in low), key=lambda x: x)
    best, pair = gap / 2 - 0.5, (None, None)
    for s in high:
        over = weight[s] - gap / 2  # what to get back
        for x, t in [(0, None), *back[max(0, (i := bisect.bisect_left(back, (over, -1))) - 1) : i + 1]]:
            if abs(over - x) < best:
                best, pair = abs(over - x), (s, t)
    return pair


def last_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The last version of a stored map and its shard of each slot; None if there is none yet."""
    try:
        stored = spark.read.schema(MAP).parquet(f"{path}/version-*")
    except AnalysisException:
        return None
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        return None
    rows = stored.where(F.col("version") == version).select("virtual_slot", "shard").collect()  # a row a slot
    return version, [shard for _, shard in sorted(map(tuple, rows))]


def append_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> DataFrame:
    """Write a version in a folder of its own, which must not exist, and read it."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    at = f"{path}/version-{version:06d}"
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(at)
    return spark.read.schema(MAP).parquet(at)


def next_map(spark: SparkSession, path: str, weight: list[int], shards: int) -> DataFrame:
    """The map to place by: the last stored version, edited and appended if the weights call for it."""
    stored = last_map(spark, path)
    if stored is None:
        stored = 0, first_map(len(weight), shards)
        append_map(spark, path, *stored)
    version, old = stored
    if len(old) != len(weight) or max(old) >= shards:
        raise ValueError(f"the stored map has {len(old)} slots and {max(old) + 1} shards")
    new = rebalance(old, weight, shards)
    if new == old:
        return spark.read.schema(MAP).parquet(f"{path}/version-{version:06d}")
    return append_map(spark, path, version + 1, new)


def place_rows(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, map_version, shard and slot (the row's place in its shard).

    ``map_path`` is the folder of the versions, in a store that driver and executors share; without one the map serves one call.
    """
    spark = docs.sparkSession
    rows = cut(slotted(docs, slots, key, text), "shard-rows")
    sums = slot_sums(rows).collect()  # at most ``slots`` rows
    weight, count = [0] * slots, [0] * slots
    for r in sums:
        weight[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.rows
    current = next_map(spark, map_path or scratch(spark, "slot-map"), weight, shards)
    before, starts = [0] * shards, []
    for version, slot, shard in sorted(map(tuple, current.collect())):  # a row a slot
        starts.append((slot, version, shard, before[shard]))
        before[shard] += count[slot]
    starts = spark.createDataFrame(starts, "virtual_slot int, version int, shard int, start bigint")
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    # The broadcast has exactly ``slots`` rows.
    placed = rows.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "virtual_slot",
        F.col("version").alias("map_version"),
        "shard",
        (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot"),
    )
