"""The change feed: debounced bursts of paths that start incremental runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..sources.scan import ignored
from .state import State

DEBOUNCE, DEBOUNCE_S = "250 milliseconds", 0.25


def relevant(events: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    return events.filter((F.col("path") != "") & ~ignored(F.col("path"), patterns))


def bursts(events: DataFrame, gap: str = DEBOUNCE, late: str | None = None, *keys: str) -> DataFrame:
    """One row per burst: events closer than the gap belong together. Works on a stream (with ``late`` as watermark) and on a table."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(*keys, F.session_window("ts", gap).alias("burst")).agg(F.count(F.lit(1)).alias("changes"))
    return grouped.select(*keys, F.col("burst.start").alias("started"), F.col("burst.end").alias("due"), "changes")


def followups(runs: DataFrame, *keys: str) -> DataFrame:
    """runs (due, took seconds) with whether the burst came due while the run before it was still busy, and so became its follow-up."""
    before = Window.partitionBy(*keys).orderBy("due")
    end = F.lag(F.col("due").cast("double") + F.col("took")).over(before)
    return runs.withColumn("followup", F.coalesce(F.col("due").cast("double") < end, F.lit(False)))


class Watcher:
    """Turns batches of changed paths into runs. A run starts when ``gap`` seconds have passed without a change; changes during a run make one run after it; a run that finds the lock taken is tried again after ``retry`` seconds; any other failure marks the watcher as failed."""

    def __init__(self, state: State, run: Callable[[], None], patterns: tuple[str, ...] = (), gap: float = DEBOUNCE_S, retry: float = 5.0):
        self.state, self.run, self.patterns, self.gap, self.retry = state, run, patterns, gap, retry
        self.lock, self.timer, self.busy, self.again, self.runs = threading.Lock(), None, False, False, 0

    def notify(self) -> None:
        """A relevant change has come."""
        self.state.pending()
        with self.lock:
            if self.busy:
                self.again = True
            else:
                self._wait(self.gap)

    def _wait(self, seconds: float) -> None:
        if self.timer:
            self.timer.cancel()
        self.timer = threading.Timer(seconds, self._fire)
        self.timer.daemon = True
        self.timer.start()

    def _fire(self) -> None:
        with self.lock:
            if self.busy:
                self.again = True
                return
            self.busy, self.again, self.timer = True, False, None
        delay = self.gap
        try:
            self.runs += 1
            self.run()
        except EngineError as e:
            if e.code == "ALREADY_RUNNING":
                self.again, delay = True, self.retry
            else:
                self.state.watcher_failed(str(e))
        except Exception as e:  # noqa: BLE001
            self.state.watcher_failed(str(e))
        with self.lock:
            self.busy = False
            if self.again:
                self.again = False
                self._wait(delay)

    def idle(self, seconds: float = 30.0) -> bool:
        """Wait until nothing runs or is due; whether that came to be."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            with self.lock:
                if not self.busy and self.timer is None:
                    return True
            time.sleep(0.01)
        return False

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """The streaming query over (ts, path) that tells this watcher of each micro-batch with a relevant path."""

        def handle(batch: DataFrame, _: int) -> None:
            if not relevant(batch, self.patterns).isEmpty():
                self.notify()

        return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def pending_flags(events: DataFrame, *keys: str) -> DataFrame:
    """keys, changes, pending_changes of events: a key with any relevant change is pending."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes")).withColumn("pending_changes", F.col("changes") > 0)
