"""What an archive's files hold, found by tasks: rows, a digest of all bytes, least and greatest key and sort time, and a Bloom filter of session ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .workers import ship

CHUNK = 1 << 20
BITS_A_KEY, HASHES = 10, 6
FILES_TO_A_TASK = 64
SURVEY = "table string, file string, rows long, digest string, low string, high string, low_time long, high_time long, bits binary"
TIMES = ("ended_at_ms", "started_at_ms", "ingested_at_ms")


def _places(key: str, size: int) -> np.ndarray:
    h = hashlib.blake2b(key.encode(), digest_size=16).digest()
    first, step = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return np.array([(first + i * step) % size for i in range(HASHES)])


def bloom(keys: Iterable[str]) -> bytes:
    """A Bloom filter of about BITS_A_KEY bits for each key; its length is a power of two."""
    keys = list(keys)
    bits = np.zeros(1 << max(6, (BITS_A_KEY * len(keys) - 1).bit_length()), bool)
    for k in keys:
        bits[_places(k, len(bits))] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, key: str) -> bool:
    at = _places(key, 8 * len(bits))
    return all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in at.tolist())


def _look(where: fs.FileSystem, path: str, key: str | None, timed: bool, filtered: bool) -> dict:
    """One file's survey; the digest is of its bytes, the rest is read from its columns, where they can be read."""
    sha = hashlib.sha256()
    with where.open_input_stream(path) as f:
        while block := f.read(CHUNK):
            sha.update(block)
    out = {"digest": sha.hexdigest()}
    with where.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        out["rows"] = file.metadata.num_rows
        keys: set[str] = set()
        for batch in file.iter_batches(columns=[c for c in (key, *(TIMES if timed else ())) if c]) if key else ():
            keys.update(k for k in batch.column(0).to_pylist() if k is not None)
            if timed:
                for values in zip(*[batch.column(c).to_pylist() for c in TIMES], strict=True):
                    at = next((v for v in values if v is not None), None)
                    if at is not None:
                        out["low_time"], out["high_time"] = min(at, out.get("low_time", at)), max(at, out.get("high_time", at))
    if keys:
        out |= {"low": min(keys), "high": max(keys), "bits": bloom(keys) if filtered else None}
    return out


def survey(spark: SparkSession, base: str, files: list[tuple[str, str]], keys: dict[str, str], timed: tuple[str, ...]) -> DataFrame:
    """A row for each (table, file below ``base``); a file that can't be read is a row without digest or rows."""
    ship(spark)
    names = ["table", "file", "rows", "digest", "low", "high", "low_time", "high_time", "bits"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(base)
        for b in batches:
            for table, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = {"table": table, "file": file}
                try:
                    row |= _look(where, f"{root}/{file}", keys.get(table), table in timed, table in keys)
                except (OSError, pa.ArrowException):
                    pass  # what is missing is the finding
                yield pa.record_batch([pa.array([row.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

    listed = spark.createDataFrame(files, "table string, file string")
    tasks = max(min(len(files), spark.sparkContext.defaultParallelism), -(-len(files) // FILES_TO_A_TASK), 1)
    return listed.repartition(tasks).mapInArrow(run, SURVEY)


def holding(surveyed: DataFrame, sessions: list[str]) -> DataFrame:
    """Of survey rows with ``commit``: table, commit, file of the files that may hold any of the sessions."""
    ship(surveyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for low, high, bits in zip(*[b.column(i).to_pylist() for i in (3, 4, 5)], strict=True):
                keep.append(low is not None and any(low <= s <= high and (bits is None or may_hold(bits, s)) for s in sessions))
            yield b.select(["table", "commit", "file"]).filter(pa.array(keep, pa.bool_()))

    return surveyed.select("table", "commit", "file", "low", "high", "bits").mapInArrow(run, "table string, commit string, file string")


def copy(files: DataFrame, base: str, target: str) -> int:
    """Copies files (``file``, below ``base``) to the same names below ``target``, each by a task, as it streams; how many there were."""
    spark = files.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (source, root), (sink, there) = fs.FileSystem.from_uri(base), fs.FileSystem.from_uri(target)
        for b in batches:
            for file in b.column(0).to_pylist():
                sink.create_dir(f"{there}/{file.rsplit('/', 1)[0]}", recursive=True)
                with source.open_input_stream(f"{root}/{file}") as i, sink.open_output_stream(f"{there}/{file}") as o:
                    while block := i.read(CHUNK):
                        o.write(block)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    dealt = files.select("file").repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
