"""Examining and parsing sources in tasks: tables of candidates and of parsed sessions.

Folders are walked in rounds, a round for each level, in tasks; names never come to the driver. A task reads a file's bytes, once to examine it and, if it is new or has changed, once to parse and store it. A file that
fails is a row with a category and a message; the others go on. Files must be at the same path wherever a task runs (a shared file system), as for any file source.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as M
from ..scratch import Scratch
from ..workers import ship
from .base import Candidate, Parsed, SourceError, categorise
from .connectors import REGISTRY

ZSTD_LEVEL = 3
FILES_TO_A_TASK = 500
BATCH_BYTES = 8_000_000
NAMES_TO_A_BATCH = 5_000

_LONG, _TEXT = T.LongType(), T.StringType()


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


CANDIDATE = T.StructType(
    [
        *_fields(_LONG, "i"), *_fields(_TEXT, "path", "locator", "native_id", "fingerprint"), *_fields(_LONG, "updated_at_ms", "bytes", "mtime_ns", "mode"), *_fields(_TEXT, "parent_session_id", "agent_type"),
        *_fields(T.ArrayType(_TEXT), "extra"), *_fields(T.ArrayType(T.StructType(_fields(_TEXT, "child", "kind"))), "spawned"), *_fields(_TEXT, "stage", "category", "message"),
    ]
)
#: A parsed source: its session with all its rows, or why there is none.
PARSED = T.StructType(
    [
        *_fields(_LONG, "i"), *_fields(_TEXT, "path", "stage", "category", "message"), *_fields(_LONG, "estimated", "n_events"),
        *_fields(M.SESSIONS, "session"), *_fields(T.ArrayType(M.EVENTS), "events"), *_fields(T.ArrayType(M.RAW_SOURCES), "sources"), *_fields(T.ArrayType(M.OBJECTS), "objects"),
    ]
)


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    return T.ArrayType(nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def _batches(rows: Iterable[tuple[dict[str, Any], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


LISTED = "folder string, path string, locator string, native_id string, parent_session_id string, extra array<string>, category string, message string"
NAMED = ("path", "locator", "native_id", "parent_session_id", "extra")


def walked(spark: SparkSession, agent: str, root: str, scratch: Scratch, tag: str) -> DataFrame:
    """LISTED rows: candidates by their names, and folders that can't be read. A round lists all folders of one level; links are not followed, a root that isn't there is empty."""
    ship(spark)
    source = REGISTRY[agent]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(spark_type)
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows: list[dict[str, Any]] = []
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if e.is_dir(follow_symlinks=False):
                                rows.append({"folder": e.path})
                            elif not e.is_symlink() and source.keeps(Path(e.path)):
                                c = source.candidate(Path(e.path))
                                rows.append({k: getattr(c, k) for k in NAMED})
                except OSError as e:
                    rows.append({"path": folder, "category": categorise(e), "message": str(e)})
                for i in range(0, len(rows), NAMES_TO_A_BATCH):
                    yield pa.RecordBatch.from_pylist(rows[i : i + NAMES_TO_A_BATCH], schema)

    spark_type = T.StructType([T.StructField(*f) for f in ((n, T.ArrayType(_TEXT) if n == "extra" else _TEXT) for n in ("folder", *NAMED, "category", "message"))])
    level = spark.createDataFrame([(root,)] if os.path.isdir(root) else [], "folder string")
    out, turn, n = None, 0, 1
    while n:
        found = scratch.write(level.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(look, LISTED), f"{tag}-{turn}")
        out = found if out is None else out.unionByName(found)
        level = found.filter("folder is not null").select("folder")
        n, turn = level.count(), turn + 1
    return out.filter("folder is null").drop("folder")


def named(paths: DataFrame, agent: str) -> DataFrame:
    """The candidates that files (``path``) are by their names."""
    ship(paths.sparkSession)
    source, kind = REGISTRY[agent], T.StructType([T.StructField(n, T.ArrayType(_TEXT) if n == "extra" else _TEXT) for n in NAMED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [source.candidate(Path(p)) for p in b.column(0).to_pylist() if p is not None]
            yield pa.RecordBatch.from_pylist([{k: getattr(c, k) for k in NAMED} for c in rows], to_arrow_schema(kind))

    return paths.select("path").distinct().mapInArrow(run, kind)


def examined(spark: SparkSession, agent: str, names: DataFrame, n: int) -> DataFrame:
    """Of ``n`` listed candidates (i, path, locator, native_id, parent_session_id, extra): their fingerprints, or failures."""
    ship(spark)
    names = names.repartition(max(1, -(-n // FILES_TO_A_TASK)))
    schema = to_arrow_schema(CANDIDATE)

    source = REGISTRY[agent]

    def one(r: dict[str, Any]) -> Iterator[tuple[dict[str, Any], int]]:
        c = Candidate(r["path"], r["locator"], r["native_id"], "", None, 0, 0, 0, parent_session_id=r["parent_session_id"], extra=r["extra"])
        try:
            for x in source.examine(c):
                yield vars(x) | {"i": r["i"], "spawned": [{"child": child, "kind": kind} for child, kind in x.spawned], "stage": None, "category": None, "message": None}, 2000
        except Exception as e:  # noqa: BLE001  one bad source is one failure
            yield r | {"stage": "discovery", "category": categorise(e), "message": str(e)}, 2000

    def run(batches):
        yield from _batches((x for b in batches for r in b.to_pylist() for x in one(r)), schema)

    return names.mapInArrow(run, CANDIDATE)


def linked(found: DataFrame, agent: str) -> DataFrame:
    """Candidates with the session that spawned them, which is part of their fingerprint."""
    edges = found.select(F.concat(F.lit(f"{agent}:"), "native_id").alias("parent"), "i", F.posexplode("spawned").alias("k", "e"))
    # Of several sessions that name one child, the last listed.
    edges = edges.groupBy(F.col("e.child").alias("child")).agg(F.max_by(F.struct("parent", F.col("e.kind").alias("kind")), F.struct("i", "k")).alias("by"))
    out = found.join(edges, F.col("native_id") == F.col("child"), "left")
    mark = F.concat_ws(":", "fingerprint", F.lit("lineage"), "by.parent", F.coalesce("by.kind", F.lit("")))
    return out.select(
        *[c for c in found.columns if c not in ("parent_session_id", "agent_type", "fingerprint", "spawned")],
        F.coalesce("by.parent", "parent_session_id").alias("parent_session_id"), F.coalesce("by.kind", "agent_type").alias("agent_type"), F.when(F.col("by").isNotNull(), mark).otherwise(F.col("fingerprint")).alias("fingerprint"),
    )


def parsed(found: DataFrame, agent: str, root: str, now_ms: int, store: bool = True) -> DataFrame:
    """Candidates' sessions with all their rows; without ``store`` only their sizes."""
    schema, spec = to_arrow_schema(nullable(PARSED)), [c for c in Candidate.__dataclass_fields__ if c != "spawned"]

    source = REGISTRY[agent]

    def one(r: dict[str, Any]) -> tuple[dict[str, Any], int]:
        c, at = Candidate(**{k: r[k] for k in spec}), {"i": r["i"], "path": r["path"]}
        try:
            p, stage = source.parse(c, root), "database"
            if p is None:
                return at, 100
            size = sum(len(s["content"]) if s["content"] is not None else os.path.getsize(s["path"]) for s in p.sources)
            at |= {"estimated": size, "n_events": len(p.events)}
            return (at | rows_of(p, c, now_ms), size) if store else (at | {"session": {"id": p.session["id"]}}, 200)
        except Exception as e:  # noqa: BLE001  one bad source is one failure
            return at | {"estimated": None, "n_events": None, "stage": e.stage if isinstance(e, SourceError) else "parsing", "category": categorise(e), "message": str(e)}, 500

    def run(batches):
        yield from _batches((one(r) for b in batches for r in b.to_pylist()), schema)

    return found.mapInArrow(run, nullable(PARSED))


def rows_of(p: Parsed, c: Candidate, now_ms: int) -> dict[str, Any]:
    """A parsed session as rows of the four tables."""
    sid, stored = p.session["id"], [captured(s, c) for s in p.sources]
    session = p.session | {"mode": "full", "fingerprint": c.fingerprint or p.session.get("fingerprint", ""), "ingested_at_ms": now_ms}
    fields = lambda kind, row: {f.name: row.get(f.name) for f in kind.fields}
    return {
        "session": fields(M.SESSIONS, session),
        "events": [fields(M.EVENTS, e | {"session_id": sid, "idx": i, "usage": fields(M.USAGE, e["usage"]) if e.get("usage") else None}) for i, e in enumerate(p.events)],
        "sources": [fields(M.RAW_SOURCES, s | {"session_id": sid}) for s, _ in stored],
        "objects": [fields(M.OBJECTS, o | {"created_at_ms": now_ms}) for _, o in stored],
    }


def captured(s: dict[str, Any], c: Candidate) -> tuple[dict[str, Any], dict[str, Any]]:
    """A source's provenance row and its stored object; the file must not change while it is read."""
    content, stat = s["content"], None
    if content is None:
        before = os.stat(s["path"])
        content = Path(s["path"]).read_bytes()
        stat = os.stat(s["path"])
        if (before.st_size, before.st_mtime_ns, before.st_mode) != (stat.st_size, stat.st_mtime_ns, stat.st_mode) or len(content) != stat.st_size:
            raise SourceError(f"{s['path']} changed while it was read", "transient_read", "database")
        if s["path"] == c.path and (stat.st_size, stat.st_mtime_ns) != (c.bytes, c.mtime_ns):
            raise SourceError(f"{s['path']} changed since it was discovered", "transient_read", "database")
    digest = hashlib.sha256(content).hexdigest()
    row = {k: s[k] for k in ("locator", "kind", "restore_path", "role")} | {"bytes": len(content), "mtime_ns": stat.st_mtime_ns if stat else None, "mode": stat.st_mode & 0o7777 if stat else None, "object_hash": digest}
    return row, {"hash": digest, "compression": "zstd", "bytes": len(content), "payload": zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(content)}
