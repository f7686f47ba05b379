"""A training corpus from raw documents: five stages, each over all that the one before kept.

Rows with null ids or texts go through every stage (a null text is empty and, as the mix takes words, never taken); an
empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, bytecnn, exact_dedup, minhash, mixing
from wavemill.llm.common import file_backed, file_order, free_names
from wavemill.llm.queries import quality_network, vocabulary
from wavemill.plans.runtime import cut, ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network holds for good (0.7 or more)."""
    ship(spark)
    (name,) = free_names(docs, "score")
    scored = bytecnn.score(docs, quality_network(spark, docs, sf_dir), name=name)
    return scored.where(F.col(name) >= 0.7).drop(name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.dedup_documents(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    ship(spark)
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target takes them, in training order.

    The order is that of the rows in the written files, part by part.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the stream, with the digests that show that they decode to it.

    ``position`` grows along the stream as the stage before wrote it.
    """
    ship(spark)
    docs = file_backed(docs, "stream")
    rows = docs.select("doc_id", "source", "text", file_order(docs).alias("position"))
    rows = bpe.encode(rows, vocabulary(), decoded="decoded")
    return bpe.digests(rows.withColumn("token_ids", F.col("ids")))


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("MinHash near-dedup", unlike),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: The first stage is a trained network, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
