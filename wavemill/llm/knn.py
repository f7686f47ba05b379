"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers (floor of ``SCALE`` times each component), so scores are exact. A
bounded sample, clustered on the driver, gives the pivots, whose number grows with the table up to ``PIVOTS``; each vector
belongs to the cell of its nearest pivot, queries and data alike. Small summaries follow: of each cell its rows and the greatest
distance from the pivot, of each query the least score that is surely among its best k (its own k-th best of the
sample, which can only rise). A query q with bound t needs the cell of pivot p and radius r only if

    q . p + |q| r >= t

and of that cell only the vectors x with g . x + s |x| >= u, where g, s and u are pivot, radius and least bound of the queries of
its own cell. The queries of a cell need what any of them needs; cells of queries whose needs are alike form a
group, where sending the data once saves more than it costs to score some pairs in vain. What a group needs is replicated to it
and no more, dealt into blocks of about ``BLOCK`` vectors against parts of ``PART`` queries, and each pair of them is solved by
matrix products in tiles. The best k of all blocks of a query are merged at the end, k rows a block.

All rows are searched; the sample only sets pivots and bounds, never the result. Groups with many
queries are split, so no task holds more than a part of queries and about a block of data, however common
one vector is. Vectors without any nearness (random directions in many dimensions) leave the bounds
nothing to rule out: then each vector goes to one group, once per part, and every pair is scored.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; a query's own id is no candidate of
it; rows that repeat an id are separate candidates, but one query if their vectors are
equal as well; ties go to the smaller id; null ids take no part; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are ignored. Scores of
large components are computed in exact integers of any size; components and scores beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.plans.runtime import cut

SCALE, TOP = 256, 5
#: Pivots at most and at least, and sampled vectors for each.
PIVOTS, FEWEST, PER_PIVOT = 512, 32, 32
#: Data and queries of a local problem, and of one matrix product in it.
BLOCK, PART, TILE = 32_768, 8192, 1024
#: Sending a vector to one more group costs about as much as scoring so many pairs.
MOVE = 200
LONG = 2**63 - 1
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def integers(vectors: DataFrame, key: str, vector: str, query) -> DataFrame:
    """vec_id, is_query, v: the rows that take part, as integers."""
    x = F.col("x")
    ok = x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull()
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = vectors.select(vectors[key].cast("bigint").alias("vec_id"), vectors[vector].cast("array<double>").alias("x"))
    rows = rows.where(ok & F.coalesce(F.forall("x", finite), F.lit(False)))
    return rows.select(
        "vec_id",
        F.coalesce(query(F.col("vec_id")), F.lit(False)).alias("is_query"),
        F.transform("x", lambda e: F.floor(e * SCALE).cast("bigint")).alias("v"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    width, flat = rows.dtype.itemsize * rows.shape[1], np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = np.frombuffer(column.buffers()[2] or b"", kind) if len(column) else np.zeros(0, kind)
    return raw[column.offset * dim : (column.offset + len(column)) * dim].reshape(-1, dim)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` pivots of a bounded sample, by a few rounds of k-means."""
    points = np.unique(sample, axis=0)
    pivots = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(6):
        cell = _nearest(points, pivots)[0]
        order = np.argsort(cell, kind="stable")
        first = np.searchsorted(cell[order], np.arange(len(pivots)))
        size = np.bincount(cell, minlength=len(pivots))
        sums = np.add.reduceat(points[order], np.minimum(first, len(points) - 1), axis=0)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return np.rint(pivots)


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
    cell = square.argmin(axis=1)
    # From the difference itself: the expanded square loses digits, and a radius must not come out too small.
    return cell, np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles while they hold them, else in 64 bits, else in integers of any size, cut to 64 bits."""
    most = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (queries, data)]
    largest = most[0] * most[1] * queries.shape[1]
    if largest < 2**53:
        return queries.astype(np.float64) @ data.astype(np.float64).T
    if largest < 2**63:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    return np.clip(queries.astype(object) @ data.astype(object).T, -LONG - 1, LONG).astype(np.int64)


def top_k(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, data row, score) of the k best of each query: own id left out, ties to the smaller id."""
    order = np.argsort(data_ids, kind="stable")
    data_ids, found = data_ids[order], []
    for a in range(0, len(queries), TILE):
        best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries[a : a + TILE]))]
        for b in range(0, len(data), 4 * TILE):
            scores = products(queries[a : a + TILE], data[order[b : b + 4 * TILE]])
            ok = ids[a : a + TILE, None] != data_ids[None, b : b + 4 * TILE]
            n = scores.shape[1]
            for row in range(len(scores)):
                at = np.flatnonzero(ok[row])
                s = scores[row, at]
                if n > 4 * k and len(s) > k:  # only scores at least the k-th best are sorted; ties at it are kept
                    high = s >= np.partition(s, -k)[-k]
                    at, s = at[high], s[high]
                # Stable, so that ties stay in the order of ids, here and between tiles.
                first = sorted(zip(s.tolist(), (at + b).tolist()), key=lambda x: -x[0])[:k]
                best[row] = sorted(best[row] + first, key=lambda x: -x[0])[:k]
        found += [(a + row, int(order[p]), int(s)) for row, own in enumerate(best) for s, p in own]
    return found


def needed(queries: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells each query may find one of its best in; a negative radius marks an empty cell."""
    length = np.sqrt((queries**2).sum(axis=1))[:, None]
    best = queries @ pivots.T + length * np.maximum(radius, 0)
    slack = 1 + 1e-9 * length * (np.sqrt((pivots**2).sum(axis=1)) + np.maximum(radius, 0))
    return (best + slack >= bound[:, None]) & (radius >= 0)


def group_cells(need: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> list[list[int]]:
    """Cells of queries whose needs are alike, as groups.

    ``need`` tells which cells the queries of each cell need, ``rows`` and ``queries`` how many vectors and queries cells
    hold. A cell joins the group where it adds the least cost of data sent and pairs scored, or begins one.
    """
    groups: list[list[int]] = []
    union: list[np.ndarray] = []
    asking: list[int] = []
    for cell in sorted(np.flatnonzero(queries), key=lambda c: (-int(need[c] @ rows), c)):
        own = int(need[cell] @ rows)
        alone, best = own * (MOVE + int(queries[cell])), None
        for g, have in enumerate(union):
            size, both = int(have @ rows), int((have | need[cell]) @ rows)
            more = (both - size) * MOVE + both * (asking[g] + int(queries[cell])) - size * asking[g]
            if more <= alone and (best is None or more < best[0]):
                best = more, g
        if best is None:
            groups.append([int(cell)])
            union.append(need[cell].copy())
            asking.append(int(queries[cell]))
        else:
            g = best[1]
            groups[g].append(int(cell))
            union[g] |= need[cell]
            asking[g] += int(queries[cell])
    return groups


def knn(
    vectors: DataFrame, query, k: int = TOP, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, part: int = PART
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each row whose id ``query`` selects."""
    spread = replicated(vectors, query, k, key, vector, block, part)
    if spread is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows, dim, kind = spread

    def solve(table: pa.Table) -> pa.Table:
        asks, ids = table["is_query"].to_numpy(), table["vec_id"].to_numpy()
        x = _unpacked(table["v"], kind, dim)
        query_rows = np.flatnonzero(asks)
        # Repeated queries are one query.
        _, pick = np.unique(np.column_stack([ids[asks].astype(np.int64), x[asks].astype(np.int64)]), axis=0, return_index=True)
        own, others = query_rows[pick], np.flatnonzero(~asks)
        found = top_k(x[own], ids[own], x[others], ids[others], k)
        ask, give, score = np.array(found, np.int64).reshape(-1, 3).T
        return pa.table({"query_id": pa.array(ids[own][ask]), "vec_id": pa.array(ids[others][give]), "score": pa.array(score)})

    best = rows.groupBy("part", "block").applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def replicated(
    vectors: DataFrame, query, k: int, key: str, vector: str, block: int, part: int
) -> tuple[DataFrame, int, type] | None:
    """part, block, is_query, vec_id, v: every query with the blocks of its group, and every vector with the parts that need it.

    With them the width and kind of the numbers in ``v``. None if there is no query.
    """
    rows = integers(vectors, key, vector, query)
    top = rows.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")
    ).first()
    if not top["n"]:
        return None
    dim, most = int(top["dim"]), max(int(top["high"]), -int(top["low"]))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    count = min(PIVOTS, max(FEWEST, int(top["n"] ** 0.5) // 4))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(count * PER_PIVOT).toArrow()
    points, point_ids = _matrix(sample["v"], dim), sample["vec_id"].to_numpy()
    pivots = pivots_of(points.astype(np.float64), count)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, asks = _matrix(batch["v"], dim), batch["vec_id"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False)
            cell, away = _nearest(x.astype(np.float64), pivots) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            bound, asking = np.full(len(x), np.nan), np.flatnonzero(asks)
            # With fewer than k others in the sample nothing is ruled out.
            bound[asking] = -np.inf
            if len(asking) and len(points) > k:
                for a in range(0, len(asking), TILE):
                    own = asking[a : a + TILE]
                    scores = products(x[own], points).astype(np.float64)
                    scores[ids[own][:, None] == point_ids[None, :]] = -np.inf
                    low = np.partition(scores, -k, axis=1)[:, -k]
                    # Scores beyond 64 bits are ties.
                    bound[own] = np.minimum(low - 1e-12 * np.abs(low), 9e18)
            columns = [batch["vec_id"], batch["is_query"], _packed(x.astype(kind)), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(bound)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "is_query", "v", "cell", "away", "bound"])

    shape = "vec_id bigint, is_query boolean, v binary, cell int, away double, bound double"
    cells = cut(rows.mapInArrow(placed, shape), "knn-cells")
    asked = F.col("is_query")
    summary = cells.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.max("away").alias("radius"),
        F.sum(asked.cast("bigint")).alias("queries"),
        F.max(F.when(asked, F.col("away"))).alias("query_radius"),
        F.min(F.when(asked, F.col("bound"))).alias("bound"),
    )
    n, queries = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    radius, near, least = np.full(len(pivots), -1.0), np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    for s in summary.collect():  # a row a pivot
        c = s["cell"]
        n[c], queries[c], radius[c] = s["n"], s["queries"], s["radius"]
        if s["queries"]:
            near[c], least[c] = s["query_radius"], s["bound"]
    if not queries.any():
        return None

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that the queries of each cell need, by batch."""
        for batch in batches:
            x, cell, bound = _unpacked(batch["v"], kind, dim).astype(np.float64), batch["cell"].to_numpy(), batch["bound"].to_numpy()
            have = np.zeros((len(pivots), len(pivots)), bool)
            for a in range(0, len(x), TILE):
                np.logical_or.at(have, cell[a : a + TILE], needed(x[a : a + TILE], bound[a : a + TILE], pivots, radius))
            own, other = np.nonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(other.astype(np.int32))], ["own", "other"])

    pairs = cells.where(asked).select("v", "cell", "bound").mapInArrow(needs, "own int, other int").distinct()
    need = np.zeros((len(pivots), len(pivots)), bool)
    for own, other in pairs.toLocalIterator():  # at most a row for two pivots
        need[own, other] = True
    groups = group_cells(need, n, queries)
    group_of = np.full(len(pivots), -1)
    for g, members in enumerate(groups):
        group_of[members] = g
    wanted = np.stack([need[members].any(axis=0) for members in groups])
    parts = np.array([max(1, -(-int(queries[members].sum()) // part)) for members in groups])
    blocks = np.array([max(1, -(-int(w @ n) // block)) for w in wanted])
    first_part = np.cumsum(parts) - parts
    order = np.concatenate([np.array(m) for m in groups])
    begins = np.cumsum([len(m) for m in groups]) - [len(m) for m in groups]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to a block of the groups that need it, each query to all blocks of its group."""
        for batch in batches:
            x, ids, cell = _unpacked(batch["v"], kind, dim).astype(np.float64), batch["vec_id"].to_numpy(), batch["cell"].to_numpy()
            if not len(x):
                continue
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            best = x @ pivots[order].T + length * near[order]
            slack = 1 + 1e-9 * length * (np.sqrt((pivots[order] ** 2).sum(axis=1)) + near[order])
            matter = (best + slack >= least[order]) & need[order][:, cell].T
            row, g = np.nonzero(np.logical_or.reduceat(matter, begins, axis=1))
            mixed = (ids[row] * 31 + row) % blocks[g]
            times = parts[g]
            data = [np.repeat(v, times) for v in (row, mixed)]
            data.append(np.repeat(first_part[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            asking = np.flatnonzero(batch["is_query"].to_numpy(zero_copy_only=False))
            g = group_of[cell[asking]]
            times = blocks[g]
            own = [np.repeat(asking, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            own.append(np.repeat(first_part[g] + ids[asking] // 7 % parts[g], times))
            row, at, to = (np.concatenate(v) for v in zip(data, own))
            is_query = np.arange(len(row)) >= len(data[0])
            columns = [pa.array(to.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(is_query)]
            columns += [batch["vec_id"].take(pa.array(row)), batch["v"].take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "is_query", "vec_id", "v"])

    return cells.mapInArrow(dealt, "part int, block int, is_query boolean, vec_id bigint, v binary"), dim, kind


def divisible(n: int):
    """Selects ids divisible by ``n``."""

    def chosen(key: Column) -> Column:
        return F.pmod(key, F.lit(n)) == 0

    return chosen
