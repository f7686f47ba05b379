"""What several corpus operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.plans.runtime import cut

#: Arrow batches of documents hold this many rows, so that a batch of long texts stays small.
BATCH_ROWS = 512


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of these names: an operator's own column takes the place of one that ``docs`` has."""
    gone = {n.lower() for n in names}
    return docs.select(*(docs[c] for c in docs.columns if c.lower() not in gone))


def text_of(text: str | Column) -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def small_batches(docs: DataFrame) -> None:
    """Bound Arrow batches by rows unless the session already asks for fewer."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def place(docs: DataFrame) -> tuple[Column, Column]:
    """The file and the number in it of each row of a table that is read from files."""
    meta = docs.metadataColumn("_metadata")
    return meta.getField("file_path"), meta.getField("row_index")


def file_backed(docs: DataFrame, name: str = "input") -> DataFrame:
    """``docs`` if its rows have a file and a row number, else a copy written to the shared folder."""
    try:
        docs.select(*place(docs))
        return docs
    except AnalysisException:
        return cut(docs, name)


def file_order(docs: DataFrame) -> Column:
    """A number that grows from row to row of a table as its files were written: the part's number, then the row's in it."""
    path, row = place(docs)
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("bigint")
    return F.shiftleft(F.coalesce(part, F.lit(0)), 40) + row
