"""Shared folders, lineage cuts and their clearing, and the package that workers get."""

import types

import pytest

from wavemill.plans import runtime


def test_tables_are_cut_and_cleared(spark):
    df = runtime.cut(spark.range(5), "five")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    runtime.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_a_cluster_needs_a_named_folder():
    def session(master, named=None):
        context = types.SimpleNamespace(master=master, applicationId="app", getConf=lambda: {})
        return types.SimpleNamespace(conf={"spark.checkpoint.dir": named}, sparkContext=context)

    assert runtime.shared_dir(session("local[4]")).startswith("file://")
    assert runtime.shared_dir(session("spark://x:1", "hdfs://shared/")) == "hdfs://shared"
    for master in ("spark://x:1", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="share"):
            runtime.shared_dir(session(master))


def test_clusters_get_a_copy_of_the_package(monkeypatch):
    sent = []
    context = types.SimpleNamespace(master="yarn", environment={"PYTHONPATH": "/elsewhere"}, addPyFile=sent.append)
    session = types.SimpleNamespace(sparkContext=context)
    runtime.ship(session)
    runtime.ship(session)
    import zipfile

    names = zipfile.ZipFile(sent[0]).namelist()
    assert len(sent) == 1 and "wavemill/plans/runtime.py" in names and not any(n.startswith("/") for n in names)
    context.environment["PYTHONPATH"] = runtime.ROOT
    runtime.ship(session)
    assert len(sent) == 1
