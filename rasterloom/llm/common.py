"""Helpers that all operators of this subpackage share.

Storage: intermediate tables go below the folder that the cluster names in
``spark.checkpoint.dir`` (read from the session). Only where that is unset and all runs in one process (``local[n]``), as in
tests, a local folder is made and set as the checkpoint folder; on a cluster it is an error.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that one Arrow batch sent to a Python worker holds at most (a single longer row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Bytes that the writer of a staged table holds in memory at most.
ROW_GROUP = 32 << 20
#: Shuffle partitions at most. A task works off its ranges or buckets one after the other, so more of them need no more tasks; the driver
#: keeps a bit for each pair of tasks (2 kB for a map task), which grows no further.
MOST_TASKS = 1 << 14


def tasks_for(spark: SparkSession, ranges: int) -> int:
    """Shuffle partitions for so many ranges: one for each up to MOST_TASKS, and no fewer than the session asks for."""
    return max(min(ranges, MOST_TASKS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # for drop_staged
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            drop_path(df.sparkSession, path)


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of df's size (from file sizes for scans), or None if it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; a worker serves many tasks, so what a task has freed goes back to the system at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Free what only cycles hold, and return free memory of Arrow's pool and of the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and offsets (n + 1) of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if big else np.int32, n + 1, col.offset * (8 if big else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    o = o - o[0]
    if col.null_count:
        gone = np.asarray(col.is_null())
        size = np.diff(o)
        if size[gone].any():  # a null row may still span bytes
            raw = raw[np.repeat(~gone, size)]
            size = np.where(gone, 0, size)
            o = np.concatenate([[0], np.cumsum(size)])
    return raw, o


def chunks(n_bytes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, at least one row."""
    total = np.cumsum(n_bytes)
    i, n = 0, len(n_bytes)
    while i < n:
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def parted(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` text bytes."""
    for batch in batches:
        for i, j in chunks(np.diff(text_bytes(batch.column(text_at))[1]), limit):
            yield batch.slice(i, j - i)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values (xor-shift and odd multipliers), in place where it can."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and powers of an odd base and of its inverse (mod 2**64), split into low and high
#: halves of the exponent: small tables serve texts of up to 2**31 bytes.
BYTE64 = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
_LOW = 16


def _table(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _halves(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(base, 1 << _LOW), _table(pow(base, 1 << _LOW, 1 << 64), 1 << (31 - _LOW))


_UP, _DOWN = _halves(BASE), _halves(pow(BASE, -1, 1 << 64))


def _first(halves: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    low, high = halves
    return (high[: (n >> _LOW) + 1, None] * low[None, : max(1, min(n, len(low)))]).ravel()[:n]


def rising(n: int) -> np.ndarray:
    """BASE**i for i < n."""
    return _first(_UP, n)


def falling(n: int) -> np.ndarray:
    """BASE**-i for i < n."""
    return _first(_DOWN, n)


def falling_at(i: np.ndarray) -> np.ndarray:
    """BASE**-i."""
    return _DOWN[0][i & ((1 << _LOW) - 1)] * _DOWN[1][i >> _LOW]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE64[data] * rising(len(data)), out=total[1:])
    return mix64((total[end] - total[start]) * falling_at(start) + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross rows, and the index of each row's first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = is_word[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    last = on.copy()
    last[:-1] &= ~on[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
