"""What running copies have done so far, told while they run."""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import SparkSession

from ..model import SyncResult

logger = logging.getLogger(__name__)
#: Seconds between two reports.
INTERVAL = 5.0


def group(table: str) -> str:
    """The job group of a table's copy."""
    return f"copy {table}"


class Watcher:
    """A thread that logs a line for each running table again and again.

    Committed rows come from the table's result, the running job's finished tasks from Spark's status
    tracker, so a table that goes in one job, as one without a key, is followed as well.
    """

    def __init__(self, spark: SparkSession, interval: float = INTERVAL):
        self.tracker, self.interval = spark.sparkContext.statusTracker(), interval
        self._running: dict[str, tuple[SyncResult, float]] = {}
        self._totals: dict[str, int] = {}
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._thread = threading.Thread(target=self._watch, name="progress", daemon=True)

    def __enter__(self) -> Watcher:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()

    def begin(self, result: SyncResult) -> None:
        with self._lock:
            self._running[result.table] = (result, time.monotonic())

    def expect(self, table: str, total: int) -> None:
        """The number of rows that the table has."""
        with self._lock:
            self._totals[table] = total

    def end(self, table: str) -> None:
        with self._lock:
            self._running.pop(table, None)

    def _watch(self) -> None:
        while not self._stop.wait(self.interval):
            with self._lock:
                running = [(result, began, self._totals.get(table, 0)) for table, (result, began) in self._running.items()]
            for result, began, total in running:
                try:
                    self._say(result, time.monotonic() - began, total)
                except Exception as e:  # noqa: BLE001  a report that can't be made must not stop a copy
                    logger.debug("no progress of %s: %s", result.table, e)

    def tasks(self, table: str) -> tuple[int, int]:
        """Finished tasks, and all, of the table's running stages."""
        done = all_ = 0
        for job in self.tracker.getJobIdsForGroup(group(table)):
            info = self.tracker.getJobInfo(job)
            if info is None or info.status != "RUNNING":
                continue
            for stage in info.stageIds:
                s = self.tracker.getStageInfo(stage)
                if s is not None:
                    done, all_ = done + s.numCompletedTasks, all_ + s.numTasks
        return done, all_

    def _say(self, result: SyncResult, seconds: float, total: int) -> None:
        done, all_ = self.tasks(result.table)
        share = result.rows / total * 100 if total > 0 else 0
        logger.info("table %s: %d of %d rows committed (%.1f%%), %d of %d running tasks done, %.0f s so far", result.table, result.rows, total, share, done, all_, seconds)
