"""Every catalogue query against its SQL, and a driver entry that works without the corpus operators."""

import duckdb
import pytest
from harness import TABLES, compare

import __spark_entry__ as entry
from wavemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF) == ""


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """The tables with events far apart, a few of them without a user, a place or a value."""
    folder = tmp_path_factory.mktemp("sparse")
    for t in set(TABLES) - {"events"}:
        (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    odd = """CASE WHEN event_id % 97 = 5 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id <> 11 THEN event_id * 1009 END AS event_id,
    CASE WHEN event_id % 53 <> 3 THEN value END AS value"""
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["q11_dc_filter", "q90_dc_quantized"])
def test_recurrence_agrees_with_sql_on_sparse_streams(spark, sparse, name):
    assert compare(catalog.QUERIES[name](spark, sparse), catalog.SQL[name], sparse) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_what_cannot_be_imported(monkeypatch):
    """A missing package, or one of its imports missing, costs only its own queries."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *rest, **more):
        if name == "regex" or name.startswith("wavemill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest, **more)

    gone = [m for m in sys.modules if m.startswith("wavemill.llm") or m == "corpus_pipeline"]
    held = {m: sys.modules.pop(m) for m in gone}
    try:
        monkeypatch.setattr(builtins, "__import__", refuse)
        monkeypatch.setitem(sys.modules, "wavemill.llm", None)
        bare = importlib.reload(entry)
        assert bare.LLM is None and set(bare.queries()) == set(catalog.QUERIES) and set(bare.oracle_sql()) == set(catalog.SQL)
    finally:
        monkeypatch.undo()
        sys.modules.update(held)
        importlib.reload(entry)
