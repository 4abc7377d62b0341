"""Ingest driven by changes: a stream of changed files, quiet for a while, into an archive.

``ingest`` reads the files that have changed since the stream's last offset from the agent's data source and hands their names to the archive. The archive compares fingerprints, so a batch
that Spark replays after a failure (the archive had committed, the checkpoint had not) finds its sessions unchanged and writes nothing.

``settled`` holds changes back until a file has been quiet: its state, for each path, is the newest mark and when that came; every change moves the path's timer, and a timer that runs out lets
the path go. A burst of changes is thus one row, and a file that keeps changing waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import datasource
from ..sources.connectors import REGISTRY

SETTLED = "path string, mark string, changes long"


def ingest(archive, agent: str, root: str, checkpoint: str, on_report: Callable[[Any], None] | None = None, interval_seconds: float = 1, once: bool = False, quiet_ms: int | None = None) -> StreamingQuery:
    """Starts the query; ``once`` takes what has changed and ends; else, with ``quiet_ms``, a file waits until it has been quiet for so long. ``checkpoint`` holds Spark's offsets and, beside them, the listings."""
    datasource.register(archive.spark, REGISTRY[agent])
    changed = archive.spark.readStream.format(agent).option("listings", f"{checkpoint.removeprefix('file://')}/listings").load(root)

    if quiet_ms is not None and not once:
        changed = settled(changed.select("path", F.coalesce("native_id", F.lit("")).alias("mark")), quiet_ms)

    def batch(rows: DataFrame, number: int) -> None:
        report = archive.ingest_files(agent, root, rows.select("path"))
        if on_report:
            on_report(report)

    writer = changed.writeStream.outputMode("update" if quiet_ms is not None and not once else "append").foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/offsets")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_seconds} seconds")).start()


class Quiet(StatefulProcessor):
    """Of each path the newest mark and the number of changes since it was last let go, until ``quiet_ms`` have passed without another."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "mark string, changes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        mark, n = self.state.get() if self.state.exists() else (None, 0)
        for part in rows:
            n += len(part)
            mark = part["mark"].iloc[-1] if len(part) else mark
        self.state.update((mark, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"path": pd.Series(dtype="str"), "mark": pd.Series(dtype="str"), "changes": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"path": [key[0]], "mark": [mark], "changes": [n]})

    def close(self) -> None:
        pass


def settled(changes: DataFrame, quiet_ms: int) -> DataFrame:
    """A stream of (path, mark) as one of SETTLED rows. Its state needs Spark's RocksDB store."""
    return changes.groupBy("path").transformWithStateInPandas(Quiet(quiet_ms), SETTLED, outputMode="Update", timeMode="ProcessingTime")
