"""Counters of scans, metrics of runs, progress of streams and of Spark's stages.

Counts are taken while a plan runs (Observation) or told by Spark; nothing is run a second time for them.
"""

from __future__ import annotations

import enum
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Priority(enum.IntEnum):
    """Of a run; each is a pool of the fair scheduler."""

    LOW = 0
    NORMAL = 1
    HIGH = 2
    CRITICAL = 3


@contextmanager
def prioritised(spark: SparkSession, priority: Priority) -> Iterator[None]:
    """Jobs of this thread go to the pool of ``priority``, as far as the scheduler is a fair one."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", priority.name.lower())
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


class ScanCounters:
    """files, bytes, errors and directories of a scan, known once its DataFrame has been run to the end."""

    def __init__(self, df: DataFrame):
        self._seen = Observation()
        good = F.col("error").isNull() if "error" in df.columns else F.lit(True)
        parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        self.df = df.observe(
            self._seen,
            F.count(F.when(good, 1)).alias("files"),
            F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).alias("bytes"),
            F.count(F.when(~good, 1)).alias("errors"),
            F.approx_count_distinct(parent).alias("directories"),
        )

    def snapshot(self) -> dict[str, int]:
        """Waits for the scan. ``directories`` (with files) is approximate."""
        return dict(self._seen.get)

    def lines(self, seconds: float) -> list[str]:
        s = self.snapshot()
        rate = s["files"] / seconds if seconds > 0 else 0.0
        return [f"files: {s['files']}", f"directories: {s['directories']}", f"size: {s['bytes'] // (1 << 20)} MB", f"errors: {s['errors']}", f"rate: {rate:.0f} files/s"]


@dataclass
class PipelineMetrics:
    """Of the batches of a pipeline: rows, milliseconds, and errors of callbacks."""

    rows: int = 0
    milliseconds: float = 0.0
    batches: int = 0
    errors: list[str] = field(default_factory=list)

    def add(self, rows: int, milliseconds: float) -> None:
        self.rows += rows
        self.milliseconds += milliseconds
        self.batches += 1

    def snapshot(self) -> dict:
        rate = self.rows * 1000 / self.milliseconds if self.milliseconds else 0.0
        return {"files_processed": self.rows, "total_processing_time_ms": self.milliseconds, "throughput": rate, "batches": self.batches, "errors": len(self.errors)}


def counted(each: Callable[[DataFrame, int], None], metrics: PipelineMetrics, strict: bool = False) -> Callable[[DataFrame, int], None]:
    """A callback of batches that counts rows and time. Its errors are counted and the stream goes on, or with ``strict`` ends."""

    def run(df: DataFrame, batch: int) -> None:
        seen, began = Observation(), time.time()
        try:
            each(df.observe(seen, F.count(F.lit(1)).alias("n")), batch)
        except Exception as e:
            metrics.errors.append(f"batch {batch}: {e}")
            if strict:
                raise
            return
        metrics.add(seen.get["n"], (time.time() - began) * 1000)

    return run


class ProgressListener(StreamingQueryListener):
    """A line for each micro-batch, and totals: rows by query name, in the order of their coming."""

    def __init__(self, out: TextIO | None = None):
        self.out = out
        self.rows: dict[str, int] = {}
        self.ended: list[str] = []

    def _say(self, text: str) -> None:
        if self.out:
            print(text, file=self.out)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self._say(f"{name}: batch {p.batchId}, {self.rows[name]} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(str(event.id))
        self._say(f"{event.id}: ended")


@contextmanager
def listening(spark: SparkSession, out: TextIO | None = sys.stderr) -> Iterator[ProgressListener]:
    listener = ProgressListener(out)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def stream_snapshot(query: StreamingQuery) -> dict:
    """Rows and batches so far, and whether the stream has ended."""
    done = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in done), "batches": len(done), "complete": not query.isActive}


def workers(spark: SparkSession) -> dict[str, int]:
    """Slots for tasks, stages and tasks that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    active = sum(s.numActiveTasks for s in stages if s)
    return {"slots": spark.sparkContext.defaultParallelism, "stages": len(stages), "active": active, "idle": int(active == 0)}
