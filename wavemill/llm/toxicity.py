"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text (A-Z lower-cased) and their beginnings of a few bytes, which words of
one stem share, learns from confirmed toxic documents and from documents whose labels are not looked at. With the
class prior p, the risk is p * E[loss(toxic, +)] + max(0, E[loss(unlabelled, -)] - p * E[loss(toxic, -)])
with the bounded sigmoid loss: the second part estimates the risk on harmless text, and where it falls below
zero in a step, the classifier has begun to learn the unlabelled sample by heart, and the step goes
back up along it instead. Training is numpy on the driver, with Adam, over the features whose shares of
the two samples differ clearly; most occur in too few documents to learn from.

The prior is estimated from the two samples alone: a feature that only toxic texts have is as much rarer in unlabelled text as
toxic text is, so the median of such ratios among the features that tell the samples apart best is taken. No label 0 is read.

Both samples are bounded by ``fit``'s parameters: at most ``toxic`` confirmed and ``unlabelled`` other documents, taken in the order of a
hash of their ids, each with its whole text. Scoring reads every word of every text, in
Arrow batches without a shuffle; the weights sent to the workers are at most ``FEATURES`` pairs of 8 bytes.

Defined cases: null and empty texts have no words and get the score of the bias; without any
toxic example, or any document, all scores are 0; labels that are null or whose documents are missing are
ignored; null ids are scored but never trained on; an empty table gives an empty
result; other columns pass through ``score`` untouched, but one of the score's name is replaced.
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

#: Words count whole and by their first so many bytes.
STEMS = (4, 5, 6)
TOXIC, UNLABELLED = 3000, 6000
#: Only features whose shares of toxic and of unlabelled documents lie this many standard errors apart get a weight, and at most so many.
APART, FEATURES = 4.5, 50_000
#: The prior if no feature tells the samples apart; features that estimate it, and the least share of toxic documents that have one.
PRIOR, TELLING, COMMON = 0.05, 50, 0.02
START, STEPS, RATE, DECAY, SEED = 6.0, 400, 0.1, 1e-6, 7
#: A step's estimate of the harmless risk may fall this far below zero before it is reversed.
SLACK = 0.0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last text, and hash and text of each feature, in any order and as often as it occurs."""
    for a, b in textnp.runs(offsets):
        at = offsets[a : b + 1] - offsets[a]
        body = data[offsets[a] : offsets[b]]
        starts, ends = textnp.word_spans(textnp.ALNUM[body], at)
        text = np.searchsorted(at, starts, side="right") - 1
        begins, stops, texts = [starts], [ends], [text]
        for k in STEMS:
            long_ = ends - starts > k
            begins.append(starts[long_])
            stops.append(starts[long_] + k)
            texts.append(text[long_])
        begin, stop = np.concatenate(begins), np.concatenate(stops)
        hashes = (textnp.span_hashes(body, begin, stop) >> np.uint64(32)).astype(np.uint32)
        # A stem is another feature than the word that is spelled like it.
        hashes[len(starts) :] ^= np.uint32(0x9E3779B9)
        yield a, b, hashes, np.concatenate(texts)


@dataclass
class Weights:
    feature: np.ndarray  # sorted 32-bit hashes
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for a, b, hashes, text in features(data, offsets) if len(self.feature) else ():
            place = np.minimum(np.searchsorted(self.feature, hashes), len(self.feature) - 1)
            hit = np.flatnonzero(self.feature[place] == hashes)
            seen = np.unique((text[hit] << 32) | place[hit])  # each feature counts once a text
            np.add.at(out, a + (seen >> 32), self.weight[seen & 0xFFFFFFFF])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each whole text."""
    data, offsets = textnp.utf8(column)
    for a, b, hashes, text in features(data, offsets):
        own = np.unique((text.astype(np.uint64) << np.uint64(32)) | hashes)
        ends = np.searchsorted(own >> np.uint64(32), np.arange(b - a + 1, dtype=np.uint64))
        for i, j in zip(ends, ends[1:]):
            yield (own[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def estimated_prior(have: list[np.ndarray], sizes: tuple[int, int], apart: np.ndarray) -> float:
    """The median ratio of a feature's unlabelled to its toxic share, among those that tell the samples apart best."""
    common = np.flatnonzero((apart >= APART) & (have[0] >= max(3, COMMON * sizes[0])))
    best = common[np.argsort(-apart[common], kind="stable")[:TELLING]]
    if not len(best):
        return PRIOR
    return float(np.clip(np.median(have[1][best] / sizes[1] / (have[0][best] / sizes[0])), 1e-3, 0.5))


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None) -> Weights:
    """Fit to feature sets of toxic and unlabelled documents; without a ``prior`` it is estimated."""
    none = np.zeros(0, np.uint32)
    if not toxic or not unlabelled:
        return Weights(none, np.zeros(0), -30.0)
    n0, n1 = len(toxic), len(unlabelled)
    names, place = np.unique(np.concatenate([*toxic, *unlabelled]), return_inverse=True)
    flat = np.split(place, [sum(map(len, toxic))])
    have = [np.bincount(x, minlength=len(names)) for x in flat]
    pooled = (have[0] + have[1] + 1) / (n0 + n1 + 2)
    apart = (have[0] / n0 - have[1] / n1) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    prior = estimated_prior(have, (n0, n1), apart) if prior is None else prior
    strong = np.argsort(-np.abs(apart), kind="stable")[:FEATURES]
    strong = np.sort(strong[np.abs(apart[strong]) >= APART])
    number = np.full(len(names), -1, np.int64)
    number[strong] = np.arange(len(strong))
    docs = [np.repeat(np.arange(len(x)), [len(d) for d in x]) for x in (toxic, unlabelled)]
    docs = [d[number[f] >= 0] for d, f in zip(docs, flat)]
    flat = [number[f][number[f] >= 0] for f in flat]
    sets = (toxic, unlabelled)
    # Begun where the loss still has a slope for every toxic document: from the sides of the features.
    w, b, n = START * np.sign(apart[strong]), float(np.log(prior / (1 - prior))), len(strong)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = [b + np.bincount(d, w[f], minlength=len(x)) for d, f, x in zip(docs, flat, sets)]
        # Sigmoid loss: a toxic document costs 1 - s, a harmless one s.
        s0, s1 = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z)
        slope0, slope1 = s0 * (1 - s0) / n0, s1 * (1 - s1) / n1
        if s1.mean() - prior * s0.mean() >= -SLACK:
            d0, d1 = -2 * prior * slope0, slope1
        else:  # climb back along the part that fell below zero
            d0, d1 = prior * slope0, -slope1
        g = DECAY * np.append(w, 0.0)
        for d, doc, f in ((d0, docs[0], flat[0]), (d1, docs[1], flat[1])):
            g[:n] += np.bincount(f, d[doc], minlength=n)[:n]
            g[n] += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w, b = w - move[:n], b - move[n]
    return Weights(names[strong], w, b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    keep,
    target: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    toxic: int = TOXIC,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> Weights:
    """Train on documents for whose ids ``keep`` holds; only labels 1 of such ids are read."""
    small_batches(docs)
    known = labels.select(labels[key].alias("id")).where((labels[target].cast("int") == 1) & labels[key].isNotNull() & keep(labels[key]))
    order = F.xxhash64("id", F.lit(SEED))
    confirmed = known.distinct().orderBy(order, "id").limit(toxic)
    ids = docs.select(docs[key].alias("id")).where(F.col("id").isNotNull() & keep(F.col("id")))
    others = ids.orderBy(order, "id").limit(unlabelled).distinct()
    # At most ``toxic`` + ``unlabelled`` rows.
    picked = confirmed.withColumn("toxic", F.lit(True)).unionByName(others.withColumn("toxic", F.lit(False)))
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text")).join(F.broadcast(picked), "id").select("id", "toxic", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in feature_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["id", "toxic", "words"])

    schema = T.StructType([rows.schema["id"], T.StructField("toxic", T.BooleanType()), T.StructField("words", T.BinaryType())])
    got = rows.mapInArrow(textnp.tidy(cut_up), schema).toArrow().sort_by([("id", "ascending"), ("toxic", "ascending"), ("words", "ascending")])
    sets, flags = [np.frombuffer(x, np.uint32) for x in got["words"].to_pylist()], got["toxic"].to_pylist()
    return train([s for s, t in zip(sets, flags) if t], [s for s, t in zip(sets, flags) if not t], prior)


def score(docs: DataFrame, weights: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability that the text is toxic."""
    small_batches(docs)
    docs = without(docs, name)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = weights.scores(*textnp.utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return docs.mapInArrow(textnp.tidy(run), schema)
