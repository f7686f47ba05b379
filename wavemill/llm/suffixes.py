"""Repeated passages: every byte inside a 50-byte string that an earlier document has too.

The exact test sorts suffixes in two stages. Of a block's text only the suffixes smaller than
their successors are sorted directly; the rest are induced from those by one scan over the buckets of
first bytes. Common prefixes of neighbours in that order then tell equal strings.

To meet, equal strings must reach the same block without moving the corpus. Each
``LENGTH``-byte string is sent by the least hash among its ``GRAM``-byte substrings, its anchor,
which depends on its bytes alone:

1. Documents equal to an earlier one go as a whole, found by digest.
2. Anchors of the others (about one in 14 places, 8 bytes each) are dealt into buckets by hash, which
   tell those that more than one document has.
3. A hot anchor, which ``HOT`` packs or more have, would draw the different neighbours of all its places into one block, more
   than fits a task. So of its strings, told apart by hash, those that one document alone has are found first, spread over all
   buckets, and left out. Without hot anchors this step is skipped, as blocks take what comes then.
4. Around shared anchors only, the strings that chose them are cut out as contexts and dealt into
   blocks by anchor; each block is suffix-sorted and answers with the least document of each string.
5. Answers return to their documents, which are joined by id.

Documents are worked on in packs of about ``PACK`` bytes, and a pack asks about an anchor or a context once
however often it has it, so a line that a third of all documents share costs one
entry a pack. Buckets and blocks hold about ``BUCKET_BYTES`` each, as their number follows the bytes, and there are
several to a task, so that one is never a task's whole work; an anchor that every pack has adds to its own
bucket 8 bytes a pack, and to its block what several documents have around it. Each step is an
exchange by key, so lost tasks are recomputed alone, and long steps are written to the shared folder.

Defined cases: null texts are empty; texts under ``LENGTH`` bytes lose nothing; texts of any length are
worked on in pieces; repeated rows all count as one document; null ids rank after all others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import textnp
from wavemill.llm.common import small_batches, text_of
from wavemill.plans.runtime import cut, release

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a pack, and for each bucket of anchors or block of contexts.
PACK, BUCKET_BYTES = 4 << 20, 8 << 20
#: Buckets and blocks for each shuffle partition, at least.
BLOCKS_A_TASK = 4
#: An anchor that so many packs have (4 GB of text) is hot: at a passage's edge its contexts are one a document, about 30 kB a pack.
HOT = 1024
#: Rows up to this many go to every executor (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
LAST = 2**63 - 1
U = np.uint64
_LOW = U((1 << 48) - 1)
_SHIFT = U(48)
MANY = 0xFFFF
_BASE = 0xD6E8FEB86659FD93


# Anchors ---------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes at each place, by doubling."""
    power = lambda k: U(pow(_BASE, k, 1 << 64))
    with np.errstate(over="ignore"):
        n, h = 1, textnp.BYTE[data]
        parts = {1: h}
        while 2 * n <= size:
            h = h[:-n] * power(n) + h[n:]
            n *= 2
            parts[n] = h
        while n < size:
            more = 1 << ((size - n).bit_length() - 1)
            m = len(data) - n - more + 1
            h = h[:m] * power(more) + parts[more][n : n + m]
            n += more
        return textnp.mix(h) | U(1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, hashes of all grams, and the least hash in each string (0 where it would leave its text)."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    h = gram_hashes(data)
    least = _slide(h, SPAN, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    least[np.arange(n) + LENGTH > ends] = 0
    edge = np.zeros(SPAN - 1, U)
    most = _slide(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    return np.flatnonzero(h == most), h, least


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges of runs of texts, with the texts' borders in them; a very long text comes in overlapping parts."""
    for a, b in textnp.runs(offsets, limit):
        low, high = int(offsets[a]), int(offsets[b])
        if b - a > 1 or high - low <= 2 * limit:
            yield low, high, offsets[a : b + 1] - low
            continue
        for at in range(low, high - LENGTH + 1, limit):
            end = min(high, at + limit + LENGTH - 1)
            yield at, end, np.array([0, end - at])


# Packs -----------------------------------------------------------------------------------------


def packs(batches: Iterator[pa.RecordBatch], limit: int, *names: str) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    """(uid, columns, bytes, borders) of packs of documents; a recomputed task makes the same packs."""
    held: list[pa.RecordBatch] = []
    seq, size, rows = TaskContext.get().partitionId() << 24, 0, 0

    def pack():
        table = pa.Table.from_batches(held)
        data, offsets = textnp.utf8(table["text"].cast(pa.large_string()))
        return seq, {n: table[n].combine_chunks() for n in names}, data, offsets

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            size += batch.column(batch.schema.get_field_index("text")).nbytes
        if size >= limit or rows > 30_000:
            yield pack()
            held, seq, size, rows = [], seq + 1, 0, 0
    if held:
        yield pack()


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["uid", "dest", "kind", "body"])


ROWS = "uid bigint, dest bigint, kind int, body binary"
ASKED, DOCS, HERE, ANSWER, HOTS = range(5)
_HOT = U(1 << 62)


def _pressed(body: bytes) -> bytes:
    """A compressed body, its length before it."""
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _loose(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def _split(dest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each destination and the places that go there."""
    order = np.argsort(dest, kind="stable")
    at = np.flatnonzero(np.r_[True, dest[order][1:] != dest[order][:-1]]) if len(dest) else []
    for i, j in zip(at, [*at[1:], len(dest)]):
        yield int(dest[order[i]]), order[i:j]


def _docs_row(uid: int, columns: dict) -> tuple[int, int, int, bytes]:
    keys = np.stack([columns["id"].to_numpy(), columns["th"].to_numpy()])
    return uid, -uid - 1, DOCS, keys.astype(np.int64).tobytes()


def _questions(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a pack asks about its (document << 48 | hash), each hash once, and those that several of its documents have."""
    hashes = own & _LOW
    order = np.argsort(hashes, kind="stable")
    own, hashes = own[order], hashes[order]
    first = np.r_[True, hashes[1:] != hashes[:-1]] if len(own) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1 if len(own) else first
    asked = own[first]
    asked[many[first]] |= U(MANY) << _SHIFT
    return asked, own[many]


def _bucketed(uid: int, asked: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    return [(uid, bucket, ASKED, asked[at].tobytes()) for bucket, at in _split(((asked & _LOW) % U(buckets)).astype(np.int64))]


def ask_anchors(buckets: int, pack: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, columns, data, offsets in packs(batches, pack, "id", "th"):
            found = []
            for low, high, borders in pieces(offsets, piece):
                at, h, _ = anchors(data[low:high], borders)
                doc = np.searchsorted(offsets, at + low, side="right") - 1
                found.append((doc.astype(U) << _SHIFT) | (h[at] >> U(16)))
            own = np.unique(np.concatenate([np.zeros(0, U), *found]))  # a document counts an anchor once
            asked, many = _questions(own)
            rows = [_docs_row(uid, columns)]
            if len(many):  # shared for certain, so no answer is needed
                rows.append((uid, -uid - 1, HERE, many.tobytes()))
            yield _rows(rows + _bucketed(uid, asked, buckets))

    return run


def _met(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's packs, entries and their packs, by hash; the group of each entry, and how many entries groups have."""
    uid, bodies = table["uid"].to_pylist(), [np.frombuffer(b, U) for b in table["body"].to_pylist()]
    entry, pack = np.concatenate(bodies), np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    order = np.argsort(entry & _LOW, kind="stable")
    entry, pack = entry[order], pack[order]
    hashes = entry & _LOW
    group = np.cumsum(np.r_[True, hashes[1:] != hashes[:-1]]) - 1
    return uid, entry, pack, group, np.bincount(group)


def answer_anchors(least: int):
    """For each pack, which anchors that only one of its documents has another pack has too, and which of its anchors ``least`` packs have."""

    def answer(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() != ASKED:  # on their way back already
            return table
        uid, entry, pack, group, count = _met(table)
        shared = np.flatnonzero((count[group] > 1) & ((entry >> _SHIFT) != MANY))
        rows = [(uid[p], -uid[p] - 1, ANSWER, entry[shared[at]].tobytes()) for p, at in _split(pack[shared])]
        hot = np.flatnonzero(count[group] >= least)
        rows += [(uid[p], -uid[p] - 1, HOTS, (entry[hot[at]] & _LOW).tobytes()) for p, at in _split(pack[hot])]
        return pa.Table.from_batches([_rows(rows)])

    return answer


def ask_strings(buckets: int, pack: int, piece: int):
    """The hashes of the strings that chose a hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, columns, data, offsets in packs(batches, pack, "id", "th", "shared"):
            shared = _by_document(columns["shared"])
            found = [key for _, _, _, key, hot in chosen_strings(data, offsets, shared, piece) for key in (key[hot],)]
            asked, _ = _questions(np.unique(np.concatenate([np.zeros(0, U), *found])))
            yield _rows([_docs_row(uid, columns), *_bucketed(uid, asked, buckets)])

    return run


def answer_strings(table: pa.Table) -> pa.Table:
    """For each pack, which of its strings no other document has."""
    if table["kind"][0].as_py() != ASKED:
        return table
    uid, entry, pack, group, count = _met(table)
    alone = np.flatnonzero((count[group] == 1) & ((entry >> _SHIFT) != MANY))
    rows = [(uid[p], -uid[p] - 1, ANSWER, entry[alone[at]].tobytes()) for p, at in _split(pack[alone])]
    return pa.Table.from_batches([_rows(rows)])


def _keys_of(table: pa.Table) -> np.ndarray:
    body = next(b for b, k in zip(table["body"].to_pylist(), table["kind"].to_pylist()) if k == DOCS)
    return np.frombuffer(body, np.int64).reshape(2, -1)


def _per_doc(keys: np.ndarray, docs: np.ndarray, values: np.ndarray, name: str) -> pa.Table:
    """A row per document with its values, which are in the documents' order."""
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    bodies = [values[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(docs)])]
    own = docs[cuts].astype(np.int64)
    return pa.table({"id": pa.array(keys[0][own]), "th": pa.array(keys[1][own]), name: pa.array(bodies, pa.binary())})


def _answers(table: pa.Table, *wanted: int) -> np.ndarray:
    parts = [np.frombuffer(b, U) for b, k in zip(table["body"].to_pylist(), table["kind"].to_pylist()) if k in wanted]
    return np.sort(np.concatenate([np.zeros(0, U), *parts]))


def anchors_by_doc(table: pa.Table) -> pa.Table:
    """The shared anchors of each document, hot ones marked."""
    own = _answers(table, HERE, ANSWER)
    hot = np.isin(own & _LOW, _answers(table, HOTS))
    out = _per_doc(_keys_of(table), (own >> _SHIFT).astype(np.int64), (own & _LOW) | np.where(hot, _HOT, U(0)), "shared")
    return out.append_column("hot", pa.array([bool((np.frombuffer(x, U) & _HOT).any()) for x in out["shared"].to_pylist()], pa.bool_()))


def strings_by_doc(table: pa.Table) -> pa.Table:
    """The strings at hot anchors that only this document has."""
    own = _answers(table, ANSWER)
    return _per_doc(_keys_of(table), (own >> _SHIFT).astype(np.int64), own & _LOW, "alone")


def _by_document(lists: pa.Array) -> np.ndarray:
    """(document << 48 | hash) of lists of hashes, with their marks; sorted but for those."""
    each = [np.frombuffer(x, U) if x else np.zeros(0, U) for x in lists.to_pylist()]
    return np.concatenate([np.zeros(0, U), *((x & _LOW) | (x & _HOT) | (U(i) << _SHIFT) for i, x in enumerate(each))])


# Contexts --------------------------------------------------------------------------------------


def chosen_strings(
    data: np.ndarray, offsets: np.ndarray, shared: np.ndarray, piece: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The strings that chose a shared anchor: their places, their anchors' numbers and hashes, (document << 48 | hash) of the strings
    themselves, and whether the anchor is hot. ``shared`` is as of ``_by_document``."""
    plain = shared & ~_HOT
    for low, high, borders in pieces(offsets, piece):
        at, h, least = anchors(data[low:high], borders)
        inside = np.flatnonzero(least)
        if not len(inside) or not len(shared):
            continue
        chosen = np.searchsorted(at, inside)
        open_ = np.flatnonzero(h[at[chosen]] != least[inside])
        while len(open_):  # the leftmost anchor of that hash
            chosen[open_] += 1
            open_ = open_[h[at[chosen[open_]]] != least[inside[open_]]]
        doc = (np.searchsorted(offsets, inside + low, side="right") - 1).astype(U) << _SHIFT
        hashes = least[inside] >> U(16)
        place = np.minimum(np.searchsorted(plain, doc | hashes), len(plain) - 1)
        hit = np.flatnonzero(plain[place] == (doc | hashes))
        if not len(hit):
            continue
        hot = (shared[place[hit]] & _HOT) > 0
        key = doc[hit]
        if hot.any():
            key = key | (gram_hashes(data[low:high], LENGTH)[inside[hit]] >> U(16))
        yield inside[hit] + low, chosen[hit], hashes[hit], key, hot


def contexts(
    data: np.ndarray, offsets: np.ndarray, shared: np.ndarray, alone: np.ndarray, piece: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First and last string, and anchor hash, of each run of strings that chose one shared anchor, but those in ``alone``."""
    for string, anchor, hashes, key, hot in chosen_strings(data, offsets, shared, piece):
        if len(alone):
            place = np.minimum(np.searchsorted(alone, key), len(alone) - 1)
            stay = ~hot | (alone[place] != key)
            string, anchor, hashes = string[stay], anchor[stay], hashes[stay]
        if not len(string):
            continue
        first = np.r_[True, (string[1:] != string[:-1] + 1) | (anchor[1:] != anchor[:-1])]
        begin = np.flatnonzero(first)
        end = np.r_[begin[1:], len(string)] - 1
        yield string[begin], string[end], hashes[begin]


def ask_contexts(blocks: int, pack: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, columns, data, offsets in packs(batches, pack, "id", "th", "shared", "alone"):
            found = list(contexts(data, offsets, _by_document(columns["shared"]), _by_document(columns["alone"]), piece))
            rows = [_docs_row(uid, columns)]
            if found:
                first, last, hashes = (np.concatenate(x) for x in zip(*found))
                doc = np.searchsorted(offsets, first, side="right") - 1
                ids = columns["id"].to_numpy()[doc]
                raw = data.tobytes()
                number: dict[bytes, int] = {}
                spans = zip(first.tolist(), (last + LENGTH).tolist())
                which = np.array([number.setdefault(raw[i:j], len(number)) for i, j in spans], np.int64)
                lowest = np.full(len(number), LAST)
                np.minimum.at(lowest, which, ids)
                where = np.zeros(len(number), U)
                where[which] = hashes
                body = np.stack([which, doc, first - offsets[doc], last - first + 1]).astype(np.int64)
                own = np.array([len(number)]).tobytes() + lowest.tobytes() + body.astype(np.uint32).tobytes()
                rows.append((uid, -uid - 1, HERE, _pressed(own)))
                texts = list(number)
                for block, at in _split((where % U(blocks)).astype(np.int64)):
                    sizes = np.array([len(texts[i]) for i in at], np.uint8)
                    head = np.array([len(at)], np.int64).tobytes() + lowest[at].tobytes() + at.astype(np.uint32).tobytes()
                    rows.append((uid, block, ASKED, _pressed(head + sizes.tobytes() + b"".join(texts[i] for i in at))))
            yield _rows(rows)

    return run


def answer_contexts(table: pa.Table) -> pa.Table:
    """For each pack, the strings of its contexts that an earlier document than the pack's own first has."""
    if table["kind"][0].as_py() != ASKED:
        return table
    uid = table["uid"].to_pylist()
    number: dict[bytes, int] = {}
    owner, ctx, own, lowest = [], [], [], []
    for p, body in enumerate(map(_loose, table["body"].to_pylist())):
        n = int(np.frombuffer(body, np.int64, 1)[0])
        low, nr = np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.uint32, n, 8 + 8 * n)
        sizes = np.frombuffer(body, np.uint8, n, 8 + 12 * n).astype(np.int64)
        ends = 8 + 13 * n + np.cumsum(sizes)
        which = [number.setdefault(body[j - s : j], len(number)) for j, s in zip(ends.tolist(), sizes.tolist())]
        owner.append(np.full(n, p))
        ctx.append(nr)
        own.append(np.array(which, np.int64))
        lowest.append(low)
    owner, ctx, own, lowest = map(np.concatenate, (owner, ctx, own, lowest))
    least = np.full(len(number), LAST)
    np.minimum.at(least, own, lowest)
    texts = list(number)
    sizes = np.array([len(t) for t in texts])
    strings = sizes - LENGTH + 1
    best = least_by_string(b"".join(texts), sizes, least)
    starts = np.cumsum(strings) - strings
    # Back to each asking context: strings whose least document is before its own.
    count = strings[own]
    row = np.repeat(np.arange(len(own)), count)
    string = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = best[starts[own][row] + string]
    hit = found < lowest[row]
    row, string, found = row[hit], string[hit], found[hit]
    rows = []
    for p, at in _split(owner[row]):
        body = np.stack([ctx[row[at]].astype(np.int64), string[at], found[at]])
        rows.append((uid[p], -uid[p] - 1, ANSWER, _pressed(body.astype(np.int64).tobytes())))
    return pa.Table.from_batches([_rows(rows)])


def spans_by_doc(table: pa.Table) -> pa.Table:
    """For each document of a pack its removed byte ranges."""
    keys, kinds, bodies = _keys_of(table), table["kind"].to_pylist(), table["body"].to_pylist()
    none = _per_doc(keys, np.zeros(0, np.int64), np.zeros(0, np.int64), "spans")
    here = next((_loose(b) for b, k in zip(bodies, kinds) if k == HERE), None)
    if here is None:
        return none
    n = int(np.frombuffer(here, np.int64, 1)[0])
    lowest = np.frombuffer(here, np.int64, n, 8)
    which, doc, first, strings = np.frombuffer(here, np.uint32, offset=8 + 8 * n).reshape(4, -1).astype(np.int64)
    best = np.repeat(lowest[:, None], SPAN, axis=1)
    for body, kind in zip(bodies, kinds):
        if kind == ANSWER:
            c, s, low = np.frombuffer(_loose(body), np.int64).reshape(3, -1)
            best[c, s] = np.minimum(best[c, s], low)
    gone = best[which] < keys[0][doc][:, None]
    gone &= np.arange(SPAN) < strings[:, None]
    row, string = np.nonzero(gone)
    doc, at = doc[row], first[row] + string
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if not len(doc):
        return none
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LENGTH)])
    end = np.r_[begin[1:], len(at)] - 1
    spans = np.column_stack([at[begin], at[end] + LENGTH])
    return _per_doc(keys, doc[begin], spans, "spans")


# Two-stage suffix sorting ----------------------------------------------------------------------


def sort_suffixes(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted places of ``text`` in the order of the suffixes there, to a depth of LENGTH bytes at least.

    ``text`` has zeros only as terminators and ends with 64 of them.
    """
    n = len(text)
    step = np.flatnonzero(text[1:] != text[:-1])
    following = step[np.minimum(np.searchsorted(step, np.arange(n)), len(step) - 1)]
    smaller = np.zeros(n, bool)  # than its successor: sorted directly
    smaller[:-1] = text[following[:-1]] < text[following[:-1] + 1]
    smaller |= text == 0
    member = wanted.copy()
    chain = np.flatnonzero(wanted & ~smaller)
    while len(chain):  # whatever is induced needs its successor
        chain = chain[~member[chain + 1] | wanted[chain + 1]] + 1
        fresh = chain[~member[chain]]
        member[fresh] = True
        chain = fresh[~smaller[fresh]]
    seeds = _sort_directly(text, np.flatnonzero(member & smaller))
    head = text[seeds]
    bounds = np.searchsorted(head, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        induced = pending[c]
        level = np.concatenate(induced) if induced else seeds[:0]
        while len(level):  # runs of one byte
            before = level - 1
            level = before[(before >= 0) & (text[before] == c) & member[before] & ~smaller[before]]
            induced.append(level)
        bucket = np.concatenate([*induced, seeds[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[member[before] & (text[before] > c)]
        for d, at in _split(text[before]):
            pending[d].append(before[at])
        pending[c] = []
    order = np.concatenate(order)
    return order[wanted[order]]


def _sort_directly(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places by the 56 bytes there, eight at a time; only ties are looked at again."""
    eight = np.arange(8)
    key = lambda p, k: np.ascontiguousarray(text[p[:, None] + (8 * k + eight)]).view(">u8")[:, 0].astype(U)
    first = key(places, 0)
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    group = np.cumsum(np.r_[0, first[1:] != first[:-1]]) if len(places) else np.zeros(0, np.int64)
    for k in range(1, 7):
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        if not len(tied):
            break
        p, g = places[tied], group[tied]
        more = key(np.minimum(p, len(text) - 64), k)
        order = np.lexsort((more, g))
        places[tied], more = p[order], more[order]
        split = np.zeros(len(places), np.int64)
        split[tied[1:]] = (g[1:] == g[:-1]) & (more[1:] != more[:-1])
        group = group + np.cumsum(split)
    return places


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes, up to LENGTH, each suffix has in common with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    width = np.arange(LENGTH)
    for a in range(1, len(order), 1 << 16):
        here = order[a : a + (1 << 16)]
        differ = text[here[:, None] + width] != text[order[a - 1 : a - 1 + len(here)][:, None] + width]
        out[a : a + len(here)] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return out


def least_by_string(raw: bytes, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string of each text (``sizes`` bytes, of document ``least``), the least document that has it."""
    body = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(body) + len(sizes) + 64, np.uint8)
    place = np.arange(len(body)) + owner
    text[place] = body + 1  # UTF-8 has no byte 255, so zero is free to end texts
    wanted = np.zeros(len(text), bool)
    whole = np.arange(len(body)) + LENGTH <= ends[owner]
    wanted[place[whole]] = True
    order = sort_suffixes(text, wanted)
    group = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    doc = np.zeros(len(text), np.int64)
    doc[place] = least[owner]
    if len(order):
        lowest = np.minimum.reduceat(doc[order], group)
        doc[order] = np.repeat(lowest, np.diff(np.r_[group, len(order)]))
    return doc[wanted]


# Operator --------------------------------------------------------------------------------------


def repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    pack: int = PACK,
    bucket_bytes: int = BUCKET_BYTES,
    piece: int = textnp.RUN_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """id, th, text, copy, spans for each row: the removed byte ranges as pairs of 64-bit numbers; ``copy`` rows lose all."""
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(
        F.coalesce(docs[key].cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text_of(docs[text])).alias("th"), text_of(docs[text]).alias("text")
    )
    long_ = rows.where(F.octet_length("text") >= LENGTH)
    narrow = cut(long_.select("id", "th", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("n")), "repeat-digests")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    # Written first, so that both sides of the join are dealt out anew and a hot digest can be split.
    first = narrow.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1")
    first = cut(first.select("digest", "least"), "repeat-first")
    copies = narrow.join(first, "digest").where("id > least").select("id", "th").distinct()
    copies = cut(copies, "repeat-copies")
    small = copies.count() <= BROADCAST_ROWS
    fresh = long_.join(F.broadcast(copies) if small else copies, ["id", "th"], "left_anti")
    blocks = max(BLOCKS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    asked = fresh.mapInArrow(ask_anchors(blocks, pack, piece), ROWS).groupBy("dest").applyInArrow(answer_anchors(hot), ROWS)
    shared = asked.groupBy("uid").applyInArrow(anchors_by_doc, "id bigint, th bigint, shared binary, hot boolean")
    shared = cut(shared, "repeat-anchors")
    del asked, first, narrow
    release(spark)
    around = fresh.join(shared.dropDuplicates(["id", "th"]), ["id", "th"]).select("id", "th", "text", "shared", "hot")
    if shared.where("hot").isEmpty():
        around = around.withColumn("alone", F.lit(None).cast("binary"))
    else:
        asked = around.where("hot").mapInArrow(ask_strings(blocks, pack, piece), ROWS).groupBy("dest").applyInArrow(answer_strings, ROWS)
        alone = cut(asked.groupBy("uid").applyInArrow(strings_by_doc, "id bigint, th bigint, alone binary"), "repeat-alone")
        del asked
        release(spark)
        around = around.join(alone.dropDuplicates(["id", "th"]), ["id", "th"], "left")
    asked = around.mapInArrow(ask_contexts(blocks, pack, piece), ROWS).groupBy("dest").applyInArrow(answer_contexts, ROWS)
    spans = asked.groupBy("uid").applyInArrow(spans_by_doc, "id bigint, th bigint, spans binary")
    spans = cut(spans, "repeat-spans").dropDuplicates(["id", "th"])
    del asked, around
    release(spark)
    told = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "th", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("copy")))
    return rows.join(told, ["id", "th"], "left")


def kept_bytes(body: np.ndarray, copy: bool, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went and in how many runs."""
    if copy:
        return b"", len(body), 1
    if not spans:
        return body.tobytes(), 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    inner = np.concatenate([[0], pairs.ravel(), [len(body)]]).reshape(-1, 2)
    left = b"".join(body[a:b].tobytes() for a, b in inner)
    return left, len(body) - len(left), len(pairs)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of ``docs``; ``sizes`` as of ``repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.utf8(batch["text"])
            copies, spans = batch["copy"].to_pylist(), batch["spans"].to_pylist()
            done = [kept_bytes(data[a:b], bool(c), s) for a, b, c, s in zip(offsets, offsets[1:], copies, spans)]
            left, gone, runs = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = repeats(docs, key, text, **sizes).mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")

