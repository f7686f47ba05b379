"""Document quality by a byte-level convolutional network in numpy.

A filter of width ``WIDTH`` over bytes is one table of 256 weights per offset, so a
convolution is table look-ups and sums. Each filter is max-pooled over chunks of two
blocks; successive chunks share a block, and together they cover the whole text. The
mean, greatest and least pooled value over all chunks go through a small hidden
layer into one probability.

The network is trained on the driver by stochastic gradient descent (Adam) with
back-propagation through the pooling, over the same overlapping chunks as scoring. The sample is bounded by ``fit``'s
parameter ``per_class``: at most so many labelled documents of each class, in the order of a hash of their id, each with its
whole text. As little text has few patterns, every sampled document, of either class, is also learnt from by a short
beginning of it. Scoring reads every byte of every text, in Arrow
batches without a shuffle; the parameters sent to the workers are about 80 kB.

Defined cases: null and empty texts are scored as ``WIDTH`` zero bytes; without labels of
both classes, or without documents, all scores are the smoothed share of the class there is (of none: a half); labels that are
null or whose documents are missing are ignored; of several labels of one document all count; null
ids are scored but never trained on; an empty table gives an empty result; other
columns pass through ``score`` untouched, but one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm import textnp
from wavemill.llm.common import small_batches, without

WIDTH, FILTERS, HIDDEN = 5, 16, 16
BLOCK = 256
CHUNK = 2 * BLOCK
#: Labelled documents of each class that are learnt from.
SAMPLE = 1500
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 32, 0.01, 1e-4, 20250731
#: Short beginnings are cut down to between all of a first chunk and 2 to the minus so many of it, by class: a very short
#: beginning of a good text is good, but one of a bad text need not be bad.
SHORTEST = (2, 6)
#: Bytes convolved at a time, so that activations stay in the cache.
PIECE = 1 << 15


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    w1: np.ndarray  # 3 FILTERS + 1 x HIDDEN
    b1: np.ndarray
    w2: np.ndarray  # HIDDEN
    b2: np.ndarray  # 1
    constant: float | None = None

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Each filter's response at each place of ``data`` but the last WIDTH - 1."""
        n = len(data) - WIDTH + 1
        out = np.empty((n, self.taps.shape[2]), np.float32)
        spare = np.empty((min(n, PIECE), out.shape[1]), np.float32)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            np.take(self.taps[0], data[a:b], axis=0, out=out[a:b], mode="clip")
            for k in range(1, WIDTH):
                np.take(self.taps[k], data[a + k : b + k], axis=0, out=spare[: b - a], mode="clip")
                out[a:b] += spare[: b - a]
        return out

    def features(self, data: np.ndarray) -> np.ndarray:
        """Mean, greatest and least of each filter over the overlapping chunks of one text."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        blocks = [
            np.maximum.reduceat(act, np.arange(0, len(act), BLOCK), axis=0)
            for a in range(0, len(data) - WIDTH + 1, 64 * BLOCK)
            if len(act := self.activations(data[a : a + 64 * BLOCK + WIDTH - 1]))
        ]
        peak = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
        if len(peak) > 1:
            peak = np.maximum(peak[1:], peak[:-1])
        pooled = np.maximum(peak + self.bias, 0)
        return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), pooled.min(axis=0), filled(len(data))])

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        hidden = np.maximum(features @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2[0], -30, 30).astype(np.float64)))


def filled(n: int | np.ndarray) -> np.ndarray:
    """How much of a first chunk a text of ``n`` bytes fills, on a log scale: little text has few patterns."""
    return np.log2(np.clip(np.atleast_1d(n), WIDTH, CHUNK) / CHUNK).astype(np.float32)


def constant(p: float) -> Network:
    z = np.zeros(0, np.float32)
    return Network(np.zeros((WIDTH, 256, 1), np.float32), z, z, z, z, z, p)


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """Fit to whole texts and their labels 0 or 1."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return constant((ones + 1) / (len(labels) + 2))
    rng = np.random.default_rng(SEED)
    docs = [_blocks(t) for t in texts]
    docs += [_blocks(t[: max(1, int(min(len(t), CHUNK) * 2.0 ** -rng.uniform(0, SHORTEST[y])))]) for t, y in zip(texts, labels)]
    labels = np.concatenate([labels, labels])
    net = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, (3 * FILTERS + 1, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.2, HIDDEN).astype(np.float32),
        np.array([np.log(ones / (len(labels) - ones))], np.float32),
    )
    names = ("taps", "bias", "w1", "b1", "w2", "b2")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step, steps = 0, EPOCHS * -(-len(docs) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            grads = _gradients(net, [docs[i] for i in picked], labels[picked].astype(np.float32))
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for n in names:
                g = grads[n] + DECAY * getattr(net, n)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                m, v = first[n] / (1 - 0.9**step), second[n] / (1 - 0.999**step)
                setattr(net, n, (getattr(net, n) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
    return net


def _blocks(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a text as rows, each with the beginning of the next, how many places each has, and the length."""
    data = np.frombuffer(text, np.uint8)
    places = max(len(data), WIDTH) - WIDTH + 1
    rows = -(-places // BLOCK)
    padded = np.zeros(rows * BLOCK + WIDTH - 1, np.uint8)
    padded[: len(data)] = data
    at = np.arange(rows)[:, None] * BLOCK + np.arange(BLOCK + WIDTH - 1)
    return padded[at], np.minimum(BLOCK, places - np.arange(rows) * BLOCK), len(data)


def _gradients(net: Network, docs: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray) -> dict[str, np.ndarray]:
    rows, places = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
    sizes = np.array([len(d[0]) for d in docs])
    act = np.zeros((len(rows), BLOCK, FILTERS), np.float32)
    for k in range(WIDTH):
        act += net.taps[k][rows[:, k : k + BLOCK]]
    for i in np.flatnonzero(places < BLOCK):
        act[i, places[i] :] = -np.inf
    where = act.argmax(axis=1)
    peak = np.take_along_axis(act, where[:, None], axis=1)[:, 0]
    # A chunk is two blocks; a text of one block is one chunk.
    chunks = np.maximum(sizes - 1, 1)
    starts = np.cumsum(chunks) - chunks
    left = np.repeat(np.cumsum(sizes) - sizes, chunks) + np.arange(chunks.sum()) - np.repeat(starts, chunks)
    right = left + np.repeat(sizes > 1, chunks)
    later = peak[right] > peak[left]
    chosen = np.where(later, right[:, None], left[:, None])
    pooled = np.maximum(np.maximum(peak[left], peak[right]) + net.bias, 0)
    mean = np.add.reduceat(pooled, starts, axis=0) / chunks[:, None]
    high, low = np.maximum.reduceat(pooled, starts, axis=0), np.minimum.reduceat(pooled, starts, axis=0)
    x = np.concatenate([mean, high, low, filled(np.array([d[2] for d in docs]))[:, None]], axis=1)
    pre = x @ net.w1 + net.b1
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2[0], -30, 30)))
    d = ((p - labels) / len(labels)).astype(np.float32)
    back = np.outer(d, net.w2) * (pre > 0)
    dx = back @ net.w1.T
    doc = np.repeat(np.arange(len(docs)), chunks)
    d_pooled = dx[doc, :FILTERS] / chunks[doc, None]
    # Greatest and least pass their gradient on to the first chunk that has that value.
    for part, value in ((1, high), (2, low)):
        hit = pooled == value[doc]
        seen = np.cumsum(hit, axis=0)
        seen -= np.concatenate([np.zeros((1, FILTERS), seen.dtype), seen])[starts][doc]
        d_pooled += np.where(hit & (seen == 1), dx[doc, part * FILTERS : (part + 1) * FILTERS], 0)
    d_pooled *= pooled > 0
    taps = np.zeros_like(net.taps)
    column = np.broadcast_to(np.arange(FILTERS), chosen.shape)
    place = where[chosen, column]
    for k in range(WIDTH):
        np.add.at(taps[k], (rows[chosen, place + k], column), d_pooled)
    return {"taps": taps, "bias": d_pooled.sum(axis=0), "w1": x.T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ d, "b2": np.array([d.sum()])}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, keep, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE
) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of a bounded sample of the label rows for which ``keep`` (of the id) holds."""
    known = labels.select(labels[key].alias("id"), labels[target].cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & keep(F.col("id")))
    shuffled = F.xxhash64("id", F.lit(SEED))
    each = [known.where(F.col("y") == y).orderBy(shuffled, "id").limit(per_class) for y in (0, 1)]
    picked = each[0].unionByName(each[1])  # at most 2 x per_class rows
    rows = docs.select(docs[key].alias("id"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("body"))
    got = rows.join(F.broadcast(picked), "id").select("id", "y", "body").toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending"), ("body", "ascending")])
    return got["body"].to_pylist(), np.array(got["y"].to_pylist(), np.int64)


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of class 1 from all bytes of the text."""
    small_batches(docs)
    docs = without(docs, name)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.utf8(batch.column(at))
            got = np.zeros(len(batch))
            if len(batch):
                got = net.probability(np.stack([net.features(data[a:b]) for a, b in zip(offsets, offsets[1:])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    return docs.mapInArrow(textnp.tidy(run), schema)


def fit(
    docs: DataFrame, labels: DataFrame, keep, target: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = SAMPLE
) -> Network:
    """Train on labelled documents for whose ids ``keep`` holds, at most ``per_class`` of either class."""
    return train(*labelled_sample(docs, labels, target, keep, key, text, per_class))
