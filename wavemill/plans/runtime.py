"""Session-level helpers: shared folders, lineage cuts and worker import paths."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process and so share all folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session names it. Only where that is unset and all runs on one machine, as in tests,
    a folder of our own is used; on a cluster that would be a different one for each machine, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not on_one_machine(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), f'wavemill-{os.getpid()}')}"


def session_dir(spark: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{shared_dir(spark)}/wavemill/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` and the operators wrote for this application; frames that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    A lineage cut that survives lost executors: later stages read files, not
    blocks that one executor holds.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout.

    Workers on this machine get its path; those of a cluster, whose path does not have it, get a copy from the driver.
    """
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT in paths:
        return
    if on_one_machine(spark):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif not getattr(spark.sparkContext, "_wavemill_shipped", False):
        package = Path(ROOT, "wavemill")
        archive = os.path.join(tempfile.mkdtemp(), "wavemill.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        spark.sparkContext._wavemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it does once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
