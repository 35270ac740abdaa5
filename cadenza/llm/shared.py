"""Spark plumbing used by every operator here: shared storage, Arrow batches, worker memory, id filters."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where spark.checkpoint.dir is unset and the session runs on one machine only (tests).
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    trim()  # the driver holds nothing of what was collected for the plan
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; nothing that is still to be computed may read them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _M_ARENA_MAX = -1, -3, -8


@functools.cache
def _frugal_allocator():
    """The C library, told to give every freed block of 256 KiB and more back at once."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(_M_MMAP_THRESHOLD, 1 << 18)
        libc.mallopt(_M_TRIM_THRESHOLD, 1 << 20)
        libc.mallopt(_M_ARENA_MAX, 2)
    return libc


def trim() -> None:
    """Give freed memory of a worker back to the system."""
    pa.default_memory_pool().release_unused()
    libc = _frugal_allocator()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function after which its worker, kept for the next task, holds no memory of this one."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal_allocator()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts don't pile up in one batch.

    The settings are read when a plan runs, so they stay in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


#: Ids that may be broadcast to filter a scan (8 bytes each); a longer list is joined by a shuffle.
BROADCAST_IDS = 600_000


def rows_of(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text with their types, and the named columns."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in the table `ids` (column doc_id)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in the table `ids` (column doc_id); a null doc_id stays."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty strings."""
    return batch.column(batch.schema.get_field_index(name)).fill_null("")


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, without copying the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `limit` bytes."""
    data, offs = offsets_of(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
