"""Near-duplicate documents by one-permutation MinHash.

One pass hashes each text's five-word shingles and makes one one-permutation
sketch: the shingle hashes are dealt into ``BINS`` bins by their top bits and each bin
keeps its least. Empty bins are filled by optimal densification: bin i borrows from
the first non-empty bin in a probing order of its own, the same for all texts, so
that bins agree with probability equal to the similarity however few shingles there are.
Four bins make a band. At similarity 0.75 one of 32 bands agrees but for
5 pairs in a million.

Texts with equal shingle sets are one class, found by digest, so groups of exact
copies of any size count once. Documents that share a band value make a bucket.
Candidate edges in a bucket are a star around its least member, m - 1 for m members. Every
candidate is confirmed on its full shingle sets. A star can miss a link between two
members that are both unlike the centre; so buckets whose members the links leave in
different components are solved once more, exactly, one of those that have the same members. In a large bucket most
members can be ruled out at linear cost: a link needs 75 % of a member's shingles in other components, so each shingle is
asked once whether members of two components have it, and a member with too few such shingles goes. What
stays is dealt by size class (sizes more than one class apart can't link) into blocks of bounded size,
whose full sets are compared block against block inside a task, which gives out a spanning
forest of the links between components and never the pairs. So no pair of a bucket that could still
join two components goes unseen. Components come from alternating large and small stars over the links.

What is summed per bucket, node or shingle is written before it is joined back, so that both sides of the
join are dealt out anew and Spark can split a hot one among tasks.

Defined cases: null and blank texts have no shingles and stay alone; with fewer than
five words the whole sequence is the one shingle; rows that repeat an id are one document with
several texts, linked to all that any of them is linked to, and each row has the size of its own text; a null id
keeps a null component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import textnp
from wavemill.llm.common import small_batches
from wavemill.plans.runtime import cut

WORDS, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Ids up to this many go to every executor (8 bytes each) to pick texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: A block of a bucket solved locally has about this many members and shingles; shingles are compared so many at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES, COLUMNS = 400, 150_000, 8192
#: The columns of a digest, and of a class: its least document and the digest.
DIGEST, CLASS = ("d1", "d2"), ("rep", "d1", "d2")
U = np.uint64
_SHIFT = U(64 - BINS.bit_length() + 1)
with np.errstate(over="ignore"):
    _PROBES = np.argsort(textnp.mix(np.arange(1, BINS * BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(BINS, BINS), axis=1)
    _PLACE = textnp.mix(np.arange(11, 11 + WORDS, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    _LANE = textnp.mix(np.arange(101, 101 + BINS, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
    _BAND = textnp.mix(np.arange(1001, 1001 + BANDS, dtype=U) * U(0xE7037ED1A0B428DB))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = textnp.utf8(column)
    for a, b in textnp.runs(offsets):
        at = offsets[a : b + 1] - offsets[a]
        hashes, first = textnp.words(data[offsets[a] : offsets[b]], at, textnp.SPACED)
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - WORDS + 1)
            rolled = np.zeros(n, U)
            for k in range(WORDS):
                rolled += hashes[k : k + n] * _PLACE[k]
            rolled = textnp.mix(rolled)
            for i, j in zip(first, first[1:]):
                if j - i >= WORDS:
                    yield np.unique(rolled[i : j - WORDS + 1])
                elif j > i:
                    few = (hashes[i:j] * _PLACE[: j - i]).sum(dtype=U) + U(j - i)
                    yield textnp.mix(textnp.mix(np.array([few], U)))
                else:
                    yield hashes[:0]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a non-empty sorted set: one value a bin."""
    bins = (shingles >> _SHIFT).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    full = np.zeros(BINS, bool)
    full[bins] = True
    values = shingles[np.minimum(first, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = _PROBES[empty, full[_PROBES[empty]].argmax(axis=1)]
        values[empty] = values[lender]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textnp.mix((textnp.mix(values) * _LANE).reshape(BANDS, ROWS).sum(axis=1, dtype=U) ^ _BAND)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """128-bit digests of sets as two numbers; null for empty sets."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    both, none = np.frombuffer(raw, np.int64).reshape(-1, 2), np.array([not len(s) for s in sets], bool)
    return [pa.array(np.ascontiguousarray(both[:, i]), mask=none) for i in (0, 1)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, U)
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        lists = [bands(sketch(s)) if len(s) else none for s in sets]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate([none, *lists]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                *_digests(sets),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            ["doc_id", "n_shingles", *DIGEST, "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *_digests(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*CLASS, "shingles"]
        )


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a digest of the shingle set; null if empty), bands."""
    small_batches(docs)
    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        textnp.tidy(_sketched), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"
    )


def full_sets(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rep, d1, d2, shingles of the classes in ``classes`` (rep, d1, d2), each read from a row of its least document."""
    ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = rows.mapInArrow(textnp.tidy(_sets), "rep bigint, d1 bigint, d2 bigint, shingles array<bigint>")
    return sets.dropDuplicates([*CLASS])


def buckets(classes: DataFrame) -> DataFrame:
    """bucket, rep, d1, d2, n, centre: members of the band buckets that hold more than one class, each with the least of its bucket."""
    each = classes.select(*CLASS, "n", F.explode("bands").alias("bucket"))
    of_least = [F.min_by(c, "rep").alias(f"c_{c}") for c in ("n", *DIGEST)]
    centres = each.groupBy("bucket").agg(F.count("*").alias("k"), F.min("rep").alias("c_rep"), *of_least)
    return each.join(cut(centres.where("k > 1").drop("k"), "near-centres"), "bucket")


def stars(members: DataFrame) -> DataFrame:
    """Candidate edges: each member of a bucket with its least, unless their sizes alone rule it out."""
    size = F.col("c_n")
    edges = members.where(
        ~((F.col("rep") == F.col("c_rep")) & (F.col("d1") == F.col("c_d1")) & (F.col("d2") == F.col("c_d2")))
        & (100 * F.least("n", size) >= PERCENT * F.greatest("n", size))
    )
    return edges.select(*(F.col(f"c_{c}").alias(f"a_{c}") for c in CLASS), *(F.col(c).alias(f"b_{c}") for c in CLASS)).distinct()


def confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the documents of edges whose full sets are similar enough."""
    both = edges
    for end in "ba":
        named = sets.select(*(F.col(c).alias(f"{end}_{c}") for c in CLASS), F.col("shingles").alias(f"s{end}"))
        both = both.join(named, [f"{end}_{c}" for c in CLASS])
    common = F.size(F.array_intersect("sa", "sb"))
    alike = 100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)
    return both.where(alike).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def open_members(members: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, rep, d1, d2, n, component: members of buckets that are not one component yet, and that may still link with another.

    Of buckets with the same members (told by their number and a 128-bit sum of hashes) one is left.
    """
    named = members.join(label, members["rep"] == label["node"], "left").select(
        "bucket", *CLASS, "n", F.coalesce("component", "rep").alias("component")
    )
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), *CLASS)).alias(f"x{seed}") for seed in (1, 2)]
    state = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum("n").alias("size"), *sums
    )
    state = state.where("low < high").groupBy("m", "size", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    large = (F.col("m") > BLOCK_MEMBERS) | (F.col("size") > BLOCK_SHINGLES)
    state = cut(state.select("bucket", large.alias("large")), "near-open")
    rows = named.join(state, "bucket")
    if state.where("large").isEmpty():
        return rows.drop("large")
    # Buckets of more than one block: whoever has too few shingles of other components can't link.
    rows = cut(rows, "near-open-members")
    wide = rows.where("large").drop("large")
    each = wide.select(*CLASS, "n", "component").distinct().join(sets, [*CLASS])
    each = cut(each.select(*CLASS, "n", "component", F.explode("shingles").alias("shingle")), "near-shingles")
    held = each.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = cut(held.where("low < high").select("shingle"), "near-held")
    alive = each.join(held, "shingle", "left_semi").groupBy(*CLASS, "n").agg(F.count("*").alias("k"))
    alive = cut(alive.where(100 * F.col("k") >= PERCENT * F.col("n")).select(*CLASS), "near-alive")
    return rows.where("not large").drop("large").unionByName(wide.join(alive, [*CLASS], "left_semi"))


def blocks(rows: DataFrame) -> DataFrame:
    """bucket, at, to, own, rep, d1, d2, component: local problems of open members, each of a block with itself or with another.

    A block is a share of the members of one size class of a bucket; a block meets those of its own class and of the next ones.
    """
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    rows = rows.withColumn("cls", cls)
    size = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counts = rows.groupBy("bucket", "cls").agg(size.alias("k"), F.min("component").alias("low"), F.max("component").alias("high"))
    # A row per bucket with an entry per size class: a few dozen at most.
    counts = counts.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "k"))).alias("k"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    rows = rows.join(cut(counts.where("low < high").select("bucket", "k"), "near-blocks"), "bucket")
    share = F.pmod(F.xxhash64(*CLASS, "bucket"), F.try_element_at("k", F.col("cls"))).cast("int")
    rows = rows.withColumn("own", F.struct(F.col("cls"), share.alias("share")))

    def others(step: int) -> Column:
        """Blocks of the class ``step`` away, none if there is no such class."""
        at = F.col("cls") + step
        last = F.coalesce(F.try_element_at("k", at), F.lit(0)) - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(at.alias("cls"), i.alias("share"))))

    none = F.array().cast("array<struct<cls:int,share:int>>")
    other = F.explode(F.concat(*(F.coalesce(others(step), none) for step in (-1, 0, 1)))).alias("other")
    rows = rows.select("bucket", *CLASS, "component", "own", other)
    return rows.select("bucket", F.least("own", "other").alias("at"), F.greatest("own", "other").alias("to"), "own", *CLASS, "component")


def _solve(table: pa.Table) -> pa.Table:
    """Links between different components of one local problem, as a spanning forest."""
    own, at, to = (table[c].combine_chunks() for c in ("own", "at", "to"))
    # A block's class and share as one number.
    own, at, to = ((x.field("cls").to_numpy().astype(np.int64) << 32) | x.field("share").to_numpy() for x in (own, at, to))
    sets = table["shingles"].combine_chunks()
    reps, component = table["rep"].to_numpy(), table["component"].to_numpy()
    rows, length = len(reps), np.diff(sets.offsets.to_numpy())
    values, column, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(rows), length)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = np.flatnonzero(own == at[0])
    right = left if at[0] == to[0] else np.flatnonzero(own == to[0])
    common = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(number[-1]) + 1 if rows else 0, COLUMNS):
        i, j = np.searchsorted(column, [begin, begin + COLUMNS])
        has = np.zeros((rows, COLUMNS), np.float32)
        has[owner[i:j], column[i:j] - begin] = 1
        common += has[left] @ has[right].T
    union = length[left][:, None] + length[right][None, :] - common
    x, y = np.nonzero((100 * common >= PERCENT * union) & (component[left][:, None] != component[right][None, :]))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i, j in zip(left[x], right[y]):
        p, q = root(component[i]), root(component[j])
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((reps[i], reps[j]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node in ``links`` (a, b), by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut(edges, "star"), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Here each pair has u > v, so a node's least neighbour is its least below.
        large = cut(large, "star-large")
        small = cut(large.groupBy("u").agg(F.min("v").alias("m")), "star-small")
        joined = large.join(small, "u")
        onto = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(onto.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")


def repeated(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the classes of an id whose rows have several texts."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIGEST for f in (F.min, F.max)]
    several = sig.groupBy("doc_id").agg(*ends).where("min_d1 <> max_d1 or min_d2 <> max_d2")
    several = cut(several.select("doc_id"), "near-repeated")
    rows = sig.join(several, "doc_id", "left_semi").join(classes.select(*CLASS), [*DIGEST])
    return rows.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def links(docs: DataFrame, sig: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """node, component of all documents that a confirmed link joins."""
    members = cut(buckets(classes), "near-members")
    sets = cut(full_sets(docs, members.select(*CLASS).distinct(), key, text), "near-sets")
    found = confirm(cut(stars(members), "near-stars"), sets).unionByName(repeated(sig, classes))
    label = cut(components(cut(found, "near-links")), "near-components")
    rest = blocks(cut(open_members(members, label, sets), "near-rest")).join(sets, [*CLASS])
    more = cut(rest.groupBy("bucket", "at", "to").applyInArrow(_solve, "a bigint, b bigint"), "near-more")
    if more.isEmpty():
        return label
    # The few links between components join them whole.
    for end in "ab":
        named = label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        more = more.join(named, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    last = cut(components(more), "near-joined").select(F.col("node").alias("component"), F.col("component").alias("least"))
    every = label.unionByName(last.select(F.col("component").alias("node"), "component")).distinct()
    return every.join(last, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    sig = cut(signatures(docs, key, text), "near-signatures")
    known = sig.where("d1 is not null and doc_id is not null")
    classes = known.groupBy(*DIGEST).agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m")).select(
        *DIGEST, F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")
    )
    classes = cut(classes, "near-classes")
    label = links(docs, known, classes, key, text)
    named = classes.select(*CLASS).join(label, F.col("rep") == F.col("node"), "left")
    named = named.select(*DIGEST, F.coalesce("component", "rep").alias("component"))
    rows = sig.select("doc_id", "n_shingles", *DIGEST).join(named, [*DIGEST], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates, with all their columns."""
    gone = cut(near_dedup(docs, key, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["_gone"], "left_anti")
