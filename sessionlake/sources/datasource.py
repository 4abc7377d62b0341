"""Native session files as Spark data sources: ``spark.read.format("codex").load("/logs")``, and streams of what has changed.

A batch read has a row for each event, or one with ``category`` and ``message`` for a file that fails. Files are put into partitions by their sizes (``partitionBytes``); each is
parsed by the connector of its agent, which may be registered by the user.

A stream (``spark.readStream.format("codex")``) has the events of files that were added or changed. Its offset is a number of listings that are stored under ``listings``, a folder that
outlives the query: a listing names each file with its size and time, and the rows between two offsets are those of the files whose marks differ, so a batch that is replayed after a
failure reads the same files. A file that is gone has no rows. :func:`streaming.changes.ingest` drives an archive with it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..workers import ship
from .base import Discovery, Source, categorise
from .connectors import REGISTRY

SCHEMA = "session_id string, agent string, idx long, kind string, name string, call_id string, is_error boolean, native_id string, parent_id string, text string, created_at_ms long, path string, category string, message string"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
PARTITION_BYTES = 64 * 1024 * 1024
FILE_BYTES = 1024 * 1024  # what opening a file is worth


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _row(**values: Any) -> tuple:
    return tuple(values.get(n) for n in NAMES)


def _events(source: Source, root: str, paths: list[str]) -> Iterator[tuple]:
    """The events of files, file by file."""
    from pathlib import Path

    for path in paths:
        try:
            for c in source.examine(source.candidate(Path(path))):
                p = source.parse(c, root)
                for i, e in enumerate(p.events if p else ()):
                    yield _row(**{k: v for k, v in e.items() if k in NAMES}, session_id=p.session["id"], agent=source.agent, idx=i, path=path)
        except Exception as e:  # noqa: BLE001  one bad file is one row
            yield _row(agent=source.agent, path=path, category=categorise(e), message=str(e))


def packed(sizes: dict[str, int], most: int) -> list[Files]:
    """Files in order, as many to a partition as stay within its bytes."""
    out, paths, held = [], [], 0
    for path, size in sorted(sizes.items()):
        if paths and held + size + FILE_BYTES > most:
            out.append(Files(paths))
            paths, held = [], 0
        paths.append(path)
        held += size + FILE_BYTES
    return out + ([Files(paths)] if paths else [])


def marks(source: Source, root: str) -> dict[str, tuple[int, int]]:
    """Size and time of each file that the connector keeps, with those of its companions."""
    out = {}
    for c in source.listing(root, Discovery()):
        try:
            stats = [os.stat(p) for p in (c.path, *c.extra) if os.path.exists(p)]
        except OSError:
            continue
        if stats:
            out[c.path] = (sum(s.st_size for s in stats), max(s.st_mtime_ns for s in stats))
    return out


class _Reader(DataSourceReader):
    def __init__(self, source: Source, root: str, most: int):
        self.source, self.root, self.most = source, root, most

    def partitions(self) -> list[Files]:
        return packed({p: size for p, (size, _) in marks(self.source, self.root).items()}, self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _events(self.source, self.root, partition.paths)


class _Changes(DataSourceStreamReader):
    """Offsets count stored listings: listing 0 is empty."""

    def __init__(self, source: Source, root: str, most: int, folder: str):
        self.source, self.root, self.most, self.folder = source, root, most, folder
        os.makedirs(folder, exist_ok=True)

    def _at(self, n: int) -> str:
        return os.path.join(self.folder, f"{n:012d}.json")

    def _listing(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        with open(self._at(n), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict[str, int]:  # noqa: N802  Spark's name
        return {"listing": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        n = max((int(f.split(".")[0]) for f in os.listdir(self.folder) if f.endswith(".json")), default=0)
        now = {p: list(m) for p, m in marks(self.source, self.root).items()}
        if now != self._listing(n):
            staged = os.path.join(self.folder, f".{os.getpid()}")
            with open(staged, "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.rename(staged, self._at(n + 1))  # whole, or not there
            n += 1
        return {"listing": n}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Files]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        return packed({p: m[0] for p, m in after.items() if before.get(p) != m}, self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _events(self.source, self.root, partition.paths)

    def commit(self, end: dict[str, int]) -> None:
        """Listings before the committed one are of no more use."""
        for name in os.listdir(self.folder):
            if name.endswith(".json") and int(name.split(".")[0]) < end["listing"]:
                os.unlink(os.path.join(self.folder, name))


def source_class(source: Source) -> type[DataSource]:
    """A data source of a connector, under its agent's name."""

    class Sessions(DataSource):
        @classmethod
        def name(cls) -> str:
            return source.agent

        def schema(self) -> str:
            return SCHEMA

        def _where(self) -> tuple[str, int]:
            root = self.options.get("path")
            if not root:
                raise ValueError(f"format {source.agent!r} needs a path")
            return root, int(self.options.get("partitionBytes", PARTITION_BYTES))

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(source, *self._where())

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            folder = self.options.get("listings")
            if not folder:
                raise ValueError("a stream needs a folder for its listings")
            return _Changes(source, *self._where(), folder)

    return Sessions


def register(spark: SparkSession, *sources: Source) -> None:
    """Makes connectors known to Spark as formats: the given ones, or all that are registered."""
    ship(spark)
    for s in sources or REGISTRY.values():
        spark.dataSource.register(source_class(s))
