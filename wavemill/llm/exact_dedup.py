"""Exact deduplication by a stateful stream with keyed state on disk.

Texts are hashed once (SHA-256). The narrow stream of (digest, doc_id,
locator) then runs through a streaming aggregation whose state lives in RocksDB,
has no watermark and so never expires: per digest it retains the stable
identifier of the row that stays, a locator of that row's content, a locator of the content met first and the
number of rows. Digests hit more than once are checked on their full bytes: the
least and the greatest text of a digest, the content met first in an earlier run among them, are equal only
if all its texts are. Should a digest ever hold different texts, its rows of this call are grouped by the texts themselves.

With a folder for ``state``, state and log outlive the call: a later call with other documents dedups them against all
before, reads nothing but its own documents and the first contents of digests that were hit again, and a
call that was killed is repeated with the same ``run`` and goes on from the log. Without one the state
serves one call.

The main path is DataFrame and SQL expressions only. A group of copies of any
size costs one state row, as rows are combined before each shuffle. The stream
takes a bounded number of files at a time.

Defined cases: a null text equals an empty one; rows with a null ``doc_id``
rank below all others; of identical rows exactly one stays (the last by
locator); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.common import file_backed, free_names, place, text_of
from wavemill.plans.runtime import cut, scratch

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What all state stores of an executor may hold in memory; the rest is on disk.
STATE_MB = 128
#: Groups up to this many are sent to every executor for the byte check (under 10 MB of digests).
BROADCAST_GROUPS = 100_000


@contextmanager
def _disk_state(spark: SparkSession):
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        # Else each store reserves megabytes of disk, however little state it holds.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _locator(docs: DataFrame) -> Column:
    path, row = place(docs)
    return F.concat_ws("#", path, F.lpad(row.cast("string"), 19, "0"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, row_id, locator of each row; hashing reads each text once."""
    return docs.select(
        F.sha2(text_of(docs[text]), 256).alias("digest"),
        docs[key].alias("row_id"),
        _locator(docs).alias("locator"),
    )


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished."""
    try:
        return bool(spark.read.format("binaryFile").load(f"{path}/_SUCCESS").columns)
    except AnalysisException:
        return False


def stream_state(narrow: DataFrame, path: str, state: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """The keyed state after all files of ``path``: digest, keeper (row_id, locator), first (run, locator), group_size.

    Files that the log in ``state`` has are not read again.
    """
    spark, fresh, batches = narrow.sparkSession, state is None, []
    state = state or scratch(spark, "dedup-state")
    classes = (
        spark.readStream.schema(narrow.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .groupBy("digest")
        .agg(
            F.max(F.struct("row_id", "locator")).alias("keeper"),
            F.min(F.struct("run", "locator")).alias("first"),
            F.count("*").alias("group_size"),
        )
    )

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/classes/batch-{number}")
        batches.append(number)

    with _disk_state(spark):
        query = (
            classes.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/log")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        try:
            query.awaitTermination()
        finally:
            query.stop()
    try:
        latest = spark.read.schema(classes.schema).parquet(f"{state}/classes/*")
    except AnalysisException:  # no file, no batch
        return spark.createDataFrame([], classes.schema)
    if fresh and len(batches) == 1:
        return latest
    # A digest is emitted by each batch that touches it; all its values only grow, but for the first, which stays.
    # Written, so that a join with it deals out both sides anew and Spark can split a hot digest.
    latest = latest.groupBy("digest").agg(
        F.max("keeper").alias("keeper"), F.min("first").alias("first"), F.max("group_size").alias("group_size")
    )
    return cut(latest, "dedup-classes")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_GROUPS else rows


def _first_contents(docs: DataFrame, touched: DataFrame, run: str, text: str) -> DataFrame | None:
    """digest, body: the contents met first, in earlier runs, of digests that this run hit again, read by their locators."""
    wanted = touched.where((F.col("group_size") > 1) & (F.col("first.run") < run))
    wanted = cut(wanted.select("digest", F.col("first.locator").alias("at")), "dedup-earlier")
    files = [r.path for r in wanted.select(F.substring_index("at", "#", 1).alias("path")).distinct().toLocalIterator()]
    if not files:
        return None
    earlier = docs.sparkSession.read.schema(docs.select(text).schema).parquet(*files)
    rows = earlier.select(_locator(earlier).alias("at"), text_of(earlier[text]).alias("body"))
    return rows.join(_few(wanted), "at").select("digest", "body")


def _collided(docs: DataFrame, touched: DataFrame, text: str, run: str | None) -> DataFrame:
    """Digests hit more than once whose texts differ in some byte; expected empty."""
    hits = _few(touched.where("group_size > 1").select("digest"))
    bodies = docs.select(F.sha2(text_of(docs[text]), 256).alias("digest"), text_of(docs[text]).alias("body"))
    bodies = bodies.join(hits, "digest", "left_semi")
    earlier = _first_contents(docs, touched, run, text) if run else None
    if earlier is not None:
        bodies = bodies.unionByName(earlier)
    return (
        bodies.groupBy("digest")
        .agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
        .where("least <> greatest")
        .select("digest")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", state: str | None = None, run: str | None = None) -> DataFrame:
    """row_id, locator, digest, keep_id, group_size, kept for each row of ``docs``.

    ``state`` is a folder that driver and executors share, for state that outlives the call; ``run`` names this call
    in it. Names must grow from call to call (by default they are times). A call that was killed must be
    repeated with its name before another begins; what it had done is not done again.
    """
    spark, lasting = docs.sparkSession, state is not None
    run = run or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    docs = file_backed(docs, "dedup-input")
    path = f"{state}/digests/{run}" if lasting else scratch(spark, "dedup-digests")
    if not (lasting and _there(spark, path)):
        digests(docs, key, text).withColumn("run", F.lit(run)).write.mode("overwrite").parquet(path)
    narrow = spark.read.parquet(path)
    classes = stream_state(narrow, f"{state}/digests/*" if lasting else path, state)
    touched = classes.join(narrow.select("digest").distinct(), "digest", "left_semi") if lasting else classes
    rows = narrow.join(classes, "digest").select("row_id", "locator", "digest", "keeper", "group_size")
    bad = cut(_collided(docs, touched, text, run if lasting else None), "dedup-collided")
    if not bad.isEmpty():
        rows = rows.join(bad, "digest", "left_anti").unionByName(_by_text(docs, bad, key, text))
    return rows.select(
        "row_id",
        "locator",
        "digest",
        F.col("keeper.row_id").alias("keep_id"),
        "group_size",
        F.struct("row_id", "locator").eqNullSafe(F.col("keeper")).alias("kept"),
    )


def _by_text(docs: DataFrame, bad: DataFrame, key: str, text: str) -> DataFrame:
    body = docs.select(
        F.sha2(text_of(docs[text]), 256).alias("digest"),
        docs[key].alias("row_id"),
        _locator(docs).alias("locator"),
        text_of(docs[text]).alias("body"),
    ).join(bad, "digest", "left_semi")
    classes = body.groupBy("digest", "body").agg(
        F.max(F.struct("row_id", "locator")).alias("keeper"), F.count("*").alias("group_size")
    )
    return body.join(classes, ["digest", "body"]).select("row_id", "locator", "digest", "keeper", "group_size")


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", state: str | None = None, run: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``state`` and ``run`` as of ``exact_dedup``."""
    docs = file_backed(docs, "dedup-input")
    gone = cut(exact_dedup(docs, key, text, state, run).where("not kept").select("locator"), "dedup-gone")
    (at,) = free_names(docs, "locator")
    gone = _few(gone.withColumnRenamed("locator", at))
    return docs.select(*docs.columns, _locator(docs).alias(at)).join(gone, at, "left_anti").drop(at)
