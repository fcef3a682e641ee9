"""What the operators share: written tables, worker paths and Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows of a small side that may be broadcast; checked by a count before every use.
BROADCAST_ROWS = 100_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gridweft-{name}-{uuid.uuid4().hex}"


#: Tables that a running operator wrote and will not need after it, by call.
_scratch: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Delete what written() leaves within, but for tables given to keep()."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            remove(df)


def keep(df: DataFrame) -> DataFrame:
    """df, which the operator's result reads: it outlives the innermost scratch()."""
    for tables in _scratch[-1:]:
        tables[:] = [t for t in tables if t is not df]
    return df


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if "/gridweft-" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast where a count proves it has at most so many rows; df must be cheap to count, and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def plain(docs: DataFrame) -> bool:
    """Whether docs is a Parquet table, perhaps with columns or rows left out: its rows then have the same file and place whenever they are read."""
    def walk(node) -> bool:
        name = node.nodeName()
        if name == "LogicalRelation":
            return "parquet" in node.toString().lower()
        return name in ("Project", "Filter", "SubqueryAlias") and node.deterministic() and walk(node.children().head())

    return "_metadata" not in docs.columns and walk(docs._jdf.queryExecution().analyzed())


def placed(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ..., and (file, place): longs that name a row, the same in every read, whatever task reads it.

    A table that isn't plain() is written once to the shared folder and kept there.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    if not plain(docs):
        docs = keep(written(docs.select(*own), "placed"))
        own = [F.col(c) for c in docs.columns]
    return docs.select(*own, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


#: Settings of the session for the batches that Python workers get, where it has none of its own: whole texts make large rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and get small batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    env.setdefault("SPARK_SIMPLIFIED_TRACEBACK", "1")  # Spark adds it to some jobs only; with one environment all jobs share their workers
    conf = spark._jsparkSession.sessionState().conf()
    for key, value in BATCHES.items():
        if not conf.contains(key):
            spark.conf.set(key, value)


def lean(run):
    """run, for mapInArrow, in a worker that gives its free memory back when a task ends: workers stay, and others need theirs."""

    def trimmed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return trimmed


def unsigned(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64)


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)


def slices(b: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Cut a batch so that each part holds about limit bytes of the column, one row at least."""
    sizes = np.diff(np.asarray(offsets(b.column(column))))
    ends = np.cumsum(sizes)
    at = 0
    while at < b.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield b.slice(at, to - at)
        at = to


def offsets(a: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1]
