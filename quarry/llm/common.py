"""What the corpus operators share: tables, scratch space and Arrow access to text."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space of every word contract: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_stored: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """Queries run here have their shuffle files deleted at their end, not at some collection of the driver's garbage (`release`)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{tag}-{uuid.uuid4().hex}"
    with spent(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _stored.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _tidy() -> None:
    """At the driver's end: delete the tables that results have been read from, unless the session has ended before."""
    spark = SparkSession.getActiveSession()
    for path in list(_stored) if spark is not None else ():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone
            return


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(df.sparkSession, df.stored_at)
    _stored.discard(df.stored_at)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column without copying the text; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return at, data


def tidied(work: Callable) -> Callable:
    """An Arrow kernel after which the worker, which waits for further tasks, gives free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text (one row at least): bounds a kernel's memory."""
    for batch in batches:
        at, _ = utf8(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
