"""Byte-level BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary can never be
merged over, so between them there is a certain cut. A table of all 65,536 byte pairs
says which pairs those are. The bytes of many texts are first cut before ASCII white space where the pair
across is such a cut and the pre-tokenizer splits there whatever stands around; the
fragments are encoded independently and their ids concatenated. Of equal fragments of a run of
texts only one is encoded (found by hash, and held against the others byte by byte). A fragment is
pre-tokenized, each piece cut again at all forced boundaries, and only what lies between is merged by
rank, all such parts of a run at once. Special tokens are found first, as the tokenizers library does.

Whole texts are encoded and decoded in Arrow batches; nothing is shuffled, and a
lost executor costs its batches only. The arrays of a run are bounded: a very long text is
worked on in parts that end at cuts.

Defined cases: a null or empty text has no ids and decodes to an empty text; bytes that
are not UTF-8, in a text or after decoding arbitrary ids, become U+FFFD; unknown ids are an error; other
columns, null ids of documents among them, pass through ``encode`` and ``decode`` untouched, but those of
their results' names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm import textnp
from wavemill.llm.common import small_batches, without

#: Fixed by the vocabulary's format: how byte-level BPE splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed by Unicode: the white space characters beyond ASCII, as UTF-8.
WIDE_WHITE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Texts are encoded in runs of about this many bytes, and decoded in runs of this many ids.
RUN_BYTES, RUN_IDS = 1 << 21, 1 << 18
#: A run of bytes without a forced boundary that is longer than this is merged by itself.
LONG_PART = 64
ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: What may stand before a cut: not white space, nor a control character, which some take for it.
SOLID = np.arange(256) > 0x20
SOLID[0x7F] = False
#: Kinds of bytes that the pre-tokenizer tells apart: letters, digits, others of ASCII, a space, and what needs the pattern.
LETTER, DIGIT, OTHER, SPACE, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = OTHER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x20], KIND[0x27] = SPACE, ODD
TWO_WHITE = np.array([int.from_bytes(w) for w in WIDE_WHITE if len(w) == 2], np.uint32)
THREE_WHITE = np.array([int.from_bytes(w) for w in WIDE_WHITE if len(w) == 3], np.uint32)


def byte_letters() -> list[str]:
    """The letter by which the vocabulary file writes each byte: itself if it prints, else the next free code point from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(map(byte_of.__getitem__, token))
        model = spec["model"]
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By left id * size + right id: the merge's rank, and by rank the id it makes.
        self.size = max(self.id_of.values()) + 1
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank.setdefault(self.id_of[a] * self.size + self.id_of[b], r)
            self.made.append(self.id_of[a + b])
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.made_of = np.array(self.made, np.int64)
        self._spread_ranks()
        self.inside = np.zeros((256, 256), bool)
        for token in self.id_of:
            for a, b in zip(token, token[1:]):
                self.inside[a, b] = True
        self.inside_flat = self.inside.ravel()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True)) or rb"(?!)")
        self.pieces = regex.compile(PIECES)
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in self.id_of.items():
            spelled[i] = token
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where fragments begin: at ASCII white space after a character that is none, if that pair of bytes is a forced cut."""
        at = np.flatnonzero(ASCII_WHITE[data[1:]] & SOLID[data[:-1]]) + 1
        at = at[~self.inside[data[at - 1], data[at]]]
        wide = np.flatnonzero(data[at - 1] >= 0x80)
        if len(wide):
            before = at[wide]
            last = (data[np.maximum(before - 3, 0)].astype(np.uint32) << 16) | (data[np.maximum(before - 2, 0)].astype(np.uint32) << 8) | data[before - 1]
            white = np.isin(last, THREE_WHITE) | np.isin(last & 0xFFFF, TWO_WHITE)
            at = np.delete(at, wide[white])
        return at

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Ids of a long run of bytes: the pair of least rank merges first, leftmost first, found by a heap over linked places."""
        n, size, rank = len(ids), self.size, self.rank
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(ids[a] * size + ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, here in zip(ids, alive) if here]

    def _spread_ranks(self) -> None:
        """The same ranks in a table with open addressing, to look up many pairs at a time, and those of two bytes by themselves."""
        pairs, ranks = (np.array(list(x), np.int64) for x in (self.rank, self.rank.values()))
        self.slots = max(2, 4 * len(pairs)).bit_length()
        self.pair_at, self.rank_at = np.full(1 << self.slots, -1), np.full(1 << self.slots, len(self.made))
        slot, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.pair_at[slot[left]] < 0]
            _, sample = np.unique(slot[free], return_index=True)
            put = free[sample]
            self.pair_at[slot[put]], self.rank_at[slot[put]] = pairs[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.slots) - 1)
        every = self.byte_ids
        self.byte_ranks = self.rank_of(np.repeat(every, 256), np.tile(every, 256))

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or as many as there are merges where there is none."""
        pair = left * self.size + right
        slot = self._slot(pair)
        out, there = self.rank_at[slot], self.pair_at[slot]
        open_ = np.flatnonzero((there != pair) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.slots) - 1)
            at = slot[open_]
            out[open_], there = self.rank_at[at], self.pair_at[at]
            open_ = open_[(there != pair[open_]) & (there >= 0)]
        return np.where(self.pair_at[slot] == pair, out, len(self.made))

    def merge_all(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short runs of bytes, and the run that each is of; one merge of every run in each round."""
        none = len(self.made)
        ids, run = self.byte_ids[data], np.repeat(np.arange(len(begin)), np.diff(begin, append=len(data)))
        rank = np.full(len(ids), none)
        pair = self.byte_ranks[(data[:-1].astype(np.int32) << 8) | data[1:]]
        rank[:-1] = np.where(run[1:] == run[:-1], pair, none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            size = np.diff(first, append=len(ids))
            least = np.minimum.reduceat(rank, first)
            if not (least < none).all():
                ended = np.repeat(least == none, size)
                done.append((ids[ended], run[ended]))
                ids, run, rank = ids[~ended], run[~ended], rank[~ended]
                size, least = size[least < none], least[least < none]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.r_[True, run[at][1:] != run[at][:-1]]]  # the leftmost of each run
            ids[at] = self.made_of[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, run, rank = ids[keep], run[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = none
            ahead = at[at + 1 < len(ids)]
            ahead = ahead[run[ahead] == run[ahead + 1]]
            rank[ahead] = self.rank_of(ids[ahead], ids[ahead + 1])
            back = at[at > 0] - 1
            back = back[run[back] == run[back + 1]]
            rank[back] = self.rank_of(ids[back], ids[back + 1])
        if not done:
            return ids, run
        ids, run = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(run, kind="stable")
        return ids[order], run[order]

    def piece_starts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which bytes begin a pre-token, in fragments that begin at ``begin``.

        Where a fragment is ASCII without apostrophes, and has no white space but one space in front, a pre-token ends
        where letters, digits and other characters meet. The rest is split by the pattern.
        """
        kind = KIND[data]
        first = np.zeros(len(data), bool)
        first[begin] = True
        spaced = kind == SPACE
        start = first.copy()
        start[1:] |= (kind[1:] != kind[:-1]) & ~(spaced[:-1] & first[:-1])
        odd = (kind == ODD) | (spaced & ~first)
        raw, end = None, np.append(begin[1:], len(data))
        for i in np.flatnonzero(np.add.reduceat(odd, begin)):
            raw = data.tobytes() if raw is None else raw
            a, b = int(begin[i]), int(end[i])
            start[a:b] = False
            for piece in self.pieces.findall(raw[a:b].decode()):
                start[a] = True
                a += len(piece.encode())
        return start

    def encode_fragments(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, one after another, and how many each has.

        Pre-tokens are cut at all forced boundaries, and each part is merged alone.
        """
        cut = self.piece_starts(data, begin)
        cut[1:] |= ~self.inside_flat[(data[:-1].astype(np.int32) << 8) | data[1:]]
        part = np.flatnonzero(cut)
        size = np.diff(part, append=len(data))
        long_ = np.flatnonzero(size > LONG_PART)
        if len(long_):
            short = size <= LONG_PART
            ids, run = self.merge_all(data[np.repeat(short, size)], np.cumsum(size[short]) - size[short])
            merged = [self._merge_long(self.byte_ids[data[part[i] : part[i] + size[i]]].tolist()) for i in long_]
            ids = np.concatenate([ids, *merged])
            run = np.concatenate([np.flatnonzero(short)[run], np.repeat(long_, [len(m) for m in merged])])
            order = np.argsort(run, kind="stable")
            ids, run = ids[order], run[order]
        else:
            ids, run = self.merge_all(data, part)
        return ids, np.diff(np.searchsorted(part[run], np.append(begin, len(data))))

    def encode_special(self, text: bytes) -> np.ndarray:
        """Ids of one text in which there are special tokens."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.encode_text(text[at : m.start()]), np.array([self.special[m[0].decode()]])]
            at = m.end()
        return np.concatenate([*out, self.encode_text(text[at:])])

    def encode_text(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return self.encode_all(data, np.array([0, len(data)]), False)[0]

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after another, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        first = np.zeros(len(data) + 1, bool)
        first[self.cuts(data)] = True
        first[offsets] = True
        begin = np.flatnonzero(first[:-1])
        size = np.diff(begin, append=len(data))
        _, sample, which = np.unique(textnp.span_hashes(data, begin, begin + size, textnp.BYTE), return_index=True, return_inverse=True)
        same = size[sample][which] == size
        if same.all():
            place = np.arange(len(data)) + np.repeat(begin[sample][which] - begin, size)
            same = np.array_equal(data[place], data)
        if not np.all(same):  # a hash of two fragments
            sample, which = np.arange(len(begin)), np.arange(len(begin))
        length = size[sample]
        own = np.cumsum(length) - length
        flat, count = self.encode_fragments(data[np.repeat(begin[sample] - own, length) + np.arange(length.sum())], own)
        start = np.cumsum(count) - count
        count, start = count[which], start[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]
        return out, np.diff(ends[np.searchsorted(begin, offsets)])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        count, out, alone = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.int64)], self._with_special(data, offsets) if special else set()
        for a, b in textnp.runs(offsets, RUN_BYTES):
            for i, j in _between(a, b, alone):
                body = data[offsets[i] : offsets[j]]
                if i in alone:
                    out.append(self.encode_special(body.tobytes()))
                    count[i] = len(out[-1])
                elif len(body) <= RUN_BYTES:
                    ids, count[i:j] = self.encode_run(body, offsets[i : j + 1] - offsets[i])
                    out.append(ids)
                else:
                    parts = [self.encode_run(part, np.array([0, len(part)]))[0] for part in self._parts(body)]
                    count[i] = sum(map(len, parts))
                    out += parts
        return np.concatenate(out), count

    def _parts(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """A very long text in parts of about RUN_BYTES that end at cuts."""
        at, size = 0, RUN_BYTES
        while at < len(text):
            ends = self.cuts(text[at : at + size]) if at + size < len(text) else [len(text) - at]
            if not len(ends):
                size *= 2
                continue
            yield text[at : at + ends[-1]]
            at, size = at + int(ends[-1]), RUN_BYTES

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """The texts that hold a special token."""
        raw, found = data.tobytes() if self.special else b"", set()
        for token in map(str.encode, self.special):
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        return found

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and where each id's begin (one more than ids)."""
        length = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), RUN_IDS):
            n, own = length[a : a + RUN_IDS], ids[a : a + RUN_IDS]
            shift = self.begins[own] - ends[a : a + len(own)]
            out[ends[a] : ends[a + len(own)]] = self.spelling[np.repeat(shift, n) + np.arange(ends[a], ends[a + len(own)])]
        return out, ends


def _between(first: int, last: int, alone: set[int]) -> Iterator[tuple[int, int]]:
    """The texts from ``first`` up to ``last`` as ranges, those in ``alone`` by themselves."""
    at = first
    for i in sorted(x for x in alone if first <= x < last):
        if i > at:
            yield at, i
        yield i, i + 1
        at = i + 1
    if last > at:
        yield at, last


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(path)


def _encoded(c: Codec, texts: pa.Array) -> pa.ListArray:
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        texts = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    ids, count = c.encode_all(*textnp.utf8(texts))
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def _decoded(c: Codec, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids; null lists are empty."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and not (0 <= flat.min() and flat.max() < len(c.lengths)):
        raise ValueError("no such token")
    count = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
    data, ends = c.decode_all(flat)
    at = ends[np.concatenate([[0], np.cumsum(count)])]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that no text has
        return pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without ``text`` but with ``ids``, the token ids of each whole text.

    With ``decoded``, the same pass also decodes the ids into a column of that name.
    """
    small_batches(docs)
    rest = without(docs, text, ids, *([decoded] if decoded else [])).columns
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()), False)]
    fields += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*(docs.schema[c] for c in rest), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [_encoded(c, batch.column(len(rest)))]
            out += [_decoded(c, out[0])] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], schema.names)

    return docs.select(*(docs[c] for c in rest), docs[text]).mapInArrow(textnp.tidy(run), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, the text of ``ids``; null ids decode to an empty text."""
    small_batches(rows)
    rows = without(rows, text)
    at = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(c, batch.column(at))], schema.names)

    return rows.mapInArrow(textnp.tidy(run), schema)


def digests(rows: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 in place of ids and text."""
    others = [rows[c] for c in rows.columns if c not in (ids, text)]
    return rows.select(
        *others,
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(text), 256).alias("decoded_sha256"),
    )
