"""Tables written into the folder that driver and executors share, so that lineage ends and a lost executor loses nothing; and batches of bounded size for Python."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id list that may be broadcast (16 bytes each: 32 MB at most).
BROADCAST_ROWS = 2_000_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and driver and executors are one process (tests).

    On a cluster a folder of one machine would lose rows, so there the setting must be there: a RuntimeError tells so.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = os.path.join(tempfile.gettempdir(), "checkpoints")
    return given.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lorekeep-{uuid.uuid4().hex}-{label}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    The tables stay until ``release`` or the end of the driver, as returned DataFrames may still read them.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_lorekeep_path", None):
            _delete(t.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def only(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with ``ids``, which is broadcast if a count proves it small, and shuffled otherwise."""
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, on, how)


#: Rows that Spark hands to Python at once: texts of some kilobytes make batches of about a megabyte, on both sides of the pipe.
BATCH_ROWS = 500


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size; freed memory goes back to the host when a task ends, as idle workers live on."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return df.mapInArrow(whole, schema)
