"""Jobs on a stream with waits, timeouts and a lifetime of their state.

A job's events change its status; so does time, without an event: a failed job
becomes pending again when its wait is over, and one that runs for too long
fails. Timers of Spark's state store fire with the watermark (``EventTime``) or
the clock (``ProcessingTime``).

Whatever was due before an event's own time happens first, so that a job comes
through the same states however its events are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "job_id long, step int, status string, tries int, at_ms long, reason string"
FINAL = ("completed", "cancelled", "failed")
#: Failures that no repetition mends.
NOT_TRANSIENT = "MODEL_NOT_READY"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Rules:
    """The third failure is final; a wait is 2 s a failure, within 1 and 30; a run may take 15 minutes; final states are kept a week."""

    tries: int = 3
    wait_ms: int = 2_000
    least_ms: int = 1_000
    most_ms: int = 30_000
    run_ms: int = 15 * 60_000
    keep_ms: int = 7 * 86_400_000


@dataclass
class Job:
    """``due`` (ms, or -1): when a wait or a run is over, or a final state is forgotten. ``step`` numbers a job's changes."""

    status: str = "pending"
    tries: int = 0
    due: int = -1
    step: int = 0

    def failed(self, at: int, reason: str, rules: Rules) -> tuple:
        self.tries += 1
        if self.tries >= rules.tries or NOT_TRANSIENT in reason:
            return self.moved("failed", at, reason, at + rules.keep_ms)
        return self.moved("waiting", at, reason, at + min(rules.most_ms, max(rules.least_ms, rules.wait_ms * self.tries)))

    def moved(self, status: str, at: int, reason: str, due: int = -1) -> tuple:
        self.status, self.due, self.step = status, due, self.step + 1
        return self.step, status, self.tries, at, reason

    def passed(self, until: int, rules: Rules) -> list[tuple]:
        """Changes that fell due by ``until``."""
        out = []
        while 0 <= self.due <= until and self.status not in FINAL:
            if self.status == "waiting":
                out.append(self.moved("pending", self.due, "retry"))
            else:
                out.append(self.failed(self.due, "timeout", rules))
        return out

    def met(self, event: str, at: int, message: str, rules: Rules) -> list[tuple]:
        """Changes by an event; what comes after a final state, or doesn't fit, changes nothing."""
        out = self.passed(at, rules)
        if self.status in FINAL:
            return out
        if event == "start" and self.status == "pending":
            out.append(self.moved("running", at, event, at + rules.run_ms))
        elif event == "fail" and self.status in ("running", "pending"):
            out.append(self.failed(at, message, rules))
        elif event == "complete" and self.status == "running":
            out.append(self.moved("completed", at, event, at + rules.keep_ms))
        elif event == "cancel":
            out.append(self.moved("cancelled", at, event, at + rules.keep_ms))
        return out


class JobProcessor(StatefulProcessor):
    """A ``Job`` for each key, and one timer for what is due next."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, tries int, due long, step int")

    def _out(self, key, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=["job_id", "step", "status", "tries", "at_ms", "reason"])

    def _kept(self, job: Job, due_before: int) -> None:
        if job.due != due_before:
            if due_before >= 0:
                self.handle.deleteTimer(due_before)
            if job.due >= 0:
                self.handle.registerTimer(job.due)
        self.state.update((job.status, job.tries, job.due, job.step))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job = Job(*self.state.get()) if self.state.exists() else Job()
        events = pd.concat(list(rows)).sort_values(["at_ms", "event"])
        before, changes = job.due, [] if job.step else [job.moved("pending", int(events["at_ms"].iloc[0]), "submit")]
        for event, at, message in zip(events["event"], events["at_ms"], events["message"]):
            changes += job.met(event, int(at), message or "", self.rules)
        self._kept(job, before)
        return self._out(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return iter(())
        job, at = Job(*self.state.get()), expiredTimerInfo.getExpiryTimeInMs()
        if job.due > at:  # a timer that an event has overtaken
            return iter(())
        if job.status in FINAL:
            self.state.clear()
            return iter(())
        changes = job.passed(at, self.rules)
        self._kept(job, -1)
        return self._out(key, changes)

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """State with timers lives in RocksDB: the session's streams use it from now on."""
    spark.conf.set(STORE, ROCKSDB)
    return spark


def timed_jobs(events: DataFrame, *, rules: Rules | None = None, time_mode: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """``job_id, step, status, tries, at, reason``: every change of the jobs of a stream of ``job_id, event, at, message``.

    Events: start, fail (``message`` says why), complete, cancel; anything else only
    makes the job known. Jobs are pending, running, waiting (for a retry), completed,
    cancelled or failed.
    """
    rows = events.select(F.col("job_id").cast("long").alias("job_id"), "event", F.col("at").cast("timestamp").alias("at"), "message")
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    changes = rows.groupBy("job_id").transformWithStateInPandas(JobProcessor(rules or Rules()), CHANGES, "update", time_mode)
    return changes.select("job_id", "step", "status", "tries", F.timestamp_millis("at_ms").alias("at"), "reason")
