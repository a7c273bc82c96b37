"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that part words: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
#: Folder of the tables made now, under the shared one, and of those made by earlier stages.
_stage: list[str] = [""]
_past: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one of our own only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="pagemill-"))
        base = _own_dir[0]
    return base.rstrip("/") + _stage[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read from there: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` on which nothing rests any more that is still to be computed."""
    for t in tables:
        _delete(t.sparkSession, t._saved_at)


def begin_stage(docs: DataFrame, name: str) -> None:
    """Tables made from now on lie in a folder of their own; folders of earlier stages go, unless ``docs`` is still read from there."""
    spark = docs.sparkSession
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    known = [leaves.apply(i) for i in range(leaves.size())]
    read = " ".join(x.relation().location().rootPaths().mkString(" ") for x in known if x.getClass().getSimpleName() == "LogicalRelation" and x.relation().getClass().getSimpleName() == "HadoopFsRelation")
    if _stage[0]:
        _past.append(work_dir(spark))
    for folder in [f for f in _past if f not in read]:
        _delete(spark, folder)
        _past.remove(folder)
    _stage[0] = f"/{name}-{uuid.uuid4().hex}"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words(text: Column) -> Column:
    """array<string>: the maximal runs of non-blank characters; none for null."""
    core = trimmed(text)
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once, however often the body (and lambdas in it) uses it."""
    return F.transform(F.array(value), body)[0]


def batches(source: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose ``column`` holds about ``most`` bytes, so that numpy work on one piece has bounded memory."""
    for batch in source:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
