"""Helpers that the training-data operators share: Arrow text access, hashing, shipping; scratch tables are the library's."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .. import workers
from ..scratch import Scratch, delete_path, shared_dir  # noqa: F401  part of this module's surface

U64 = np.uint64


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*[df[n] for n in names])


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: its cleaner goes by what the driver's collector finds unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay under ``most``; a longer row is a block of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def window_hashes(data: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``k`` consecutive elements: a polynomial over 2^64, by doubling.

    h_{2m}(i) = h_m(i) * b^m + h_m(i+m), so log2(k) passes make all windows.
    """
    n = len(data)
    if n < k:
        return np.zeros(0, U64)
    step = mix(data.astype(U64) + U64(1)) if data.dtype != U64 else data
    out, done, power, width = None, 0, pow(base, 1, 1 << 64), 1
    while True:
        if k & width:
            if out is None:
                out = step
            else:
                m = n - done - width + 1
                out = out[:m] * U64(power) + step[done : done + m]
            done += width
        if done == k:
            return mix(out[: n - k + 1])
        m = n - 2 * width + 1
        step = step[:m] * U64(power) + step[width : width + m]
        power = pow(power, 2, 1 << 64)
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive elements, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def trimmed(run):
    """A mapInArrow function that gives memory back to the system when its partition is done, as workers are reused."""

    def with_trim(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return with_trim


_SENT: dict[tuple[str, str], str] = {}


def send_file(spark: SparkSession, path: str) -> str:
    """Sends a driver's file to all executors, once per application; its name for :func:`sent_file`."""
    name = path.rsplit("/", 1)[-1]
    context = spark.sparkContext
    known = _SENT.setdefault((context.applicationId, name), path)
    if known != path:
        raise ValueError(f"{name} was sent from {known}; {path} needs another name")
    context.addFile(path)
    return name


def sent_file(name: str) -> str:
    """Where a worker finds a file that was sent."""
    return SparkFiles.get(name)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run, and keeps their batches small."""
    workers.small_batches(spark)
    workers.ship(spark)
