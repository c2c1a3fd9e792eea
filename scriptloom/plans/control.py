"""Actions that run beside their caller: progress, counts while they run, and cancel.

Progress is read from Spark's own status tracker (tasks that have ended, of all tasks of the action's jobs
so far), and counts ride along with the rows (``Observation``): neither starts a job.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Outcomes that ``observed`` counts apart.
STATUSES = ("ok", "error", "skipped", "unsupported_doc", "collision")


class Cancelled(RuntimeError):
    """The action was cancelled; what it had finished before stays."""


def observed(results: DataFrame, statuses: Sequence[str] = STATUSES) -> tuple[DataFrame, Observation]:
    """Rows with a status, and counts by status (and of all, as ``total``) once an action has used them."""
    counts = Observation(f"statuses-{uuid.uuid4().hex}")
    return results.observe(counts, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]), counts


class Run:
    """An action in a thread of its own, its jobs under one tag and one group."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any], on_progress: Callable[[int], None] | None = None, interval: float = 0.1) -> None:
        self.spark, self.action, self.on_progress, self.interval = spark, action, on_progress, interval
        self.tag = f"run-{uuid.uuid4().hex}"
        self.percent, self.cancelled = 0, False
        self._value: Any = None
        self._error: BaseException | None = None
        self._thread = InheritableThread(target=self._work)
        self._thread.start()

    def _work(self) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self.tag, "a run that can be cancelled", interruptOnCancel=True)
        context.addJobTag(self.tag)
        try:
            self._value = self.action()
        except BaseException as error:  # handed to the caller by result()
            self._error = error

    def poll(self) -> int:
        """Per cent of the tasks known so far; it never falls, and reaches 100 only when the action has succeeded."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                held = tracker.getStageInfo(stage)
                if held is not None:
                    done, total = done + held.numCompletedTasks, total + held.numTasks
        finished = not self._thread.is_alive() and self._error is None
        now = 100 if finished else min(99, 100 * done // total if total else 0)
        self.percent = max(self.percent, now)
        return self.percent

    def cancel(self) -> None:
        """Stop the running jobs, and any that the action would still start."""
        self.cancelled = True
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(self.interval)

    def result(self) -> Any:
        """Wait, telling the callback each new per cent; the action's value or its error."""
        told = -1
        while True:
            alive = self._thread.is_alive()
            if self.poll() > told and self.on_progress is not None:
                self.on_progress(self.percent)
            told = self.percent
            if not alive:
                break
            time.sleep(self.interval)
        if self._error is not None:
            raise Cancelled(self.tag) if self.cancelled else self._error
        return self._value
