"""Helpers that the operators of this subpackage share: the shared folder, Arrow batches and word arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step takes at a time; a longer document is a step of its own.
STEP_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, as in tests, a local session gets a
    folder of its machine; a cluster is refused, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OPEN: list[list[tuple[DataFrame, str]]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append((written, path))
    return written


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that nothing refers to any more. Spark deletes them when the driver's garbage is
    collected, which on a driver with little to do comes late."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are materialised inside, but for those handed to the function that it gives. What is kept must
    be written already; results that are still to be computed may not depend on the others."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _OPEN.append([])
    try:
        yield keep
    finally:
        mine = _OPEN.pop()
        for df, path in mine:
            if not any(df is k for k in kept):
                remove(spark, path)
            elif _OPEN:
                _OPEN[-1].append((df, path))


#: Rows of whole texts that Arrow moves at a time.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Have Arrow move fewer rows at a time: whole texts are long, and two copies of a batch are held on each side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def trim() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What a worker keeps between the tasks of one job; tasks of others, in the same worker, let go of it.
KEPT: dict[str, object] = {}


def trimmed(batches_of: Callable, keeps: bool = False) -> Callable:
    """A function over batches that trims the worker when a task ends; `keeps`: it works with what is in KEPT."""

    @wraps(batches_of)
    def run(batches):
        if not keeps:
            KEPT.clear()
        try:
            yield from batches_of(batches)
        finally:
            trim()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets, from 0; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes: first row, end row, bytes, offsets within these bytes."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit keys."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the place of its first word (rows + 1)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_bytes_key(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word as it stands."""
    return word_keys(data, starts, ends, lower=False)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit key of each word, with A-Z lower-cased: differences of one running polynomial over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_KEYS[_LOWER[data] if lower else data] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
