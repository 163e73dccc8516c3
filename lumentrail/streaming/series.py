"""The timeline operators on streams, and a job queue's state.

Event times without zone are cast to timestamps, which watermarks need. A session
here ends a gap after its last row, so a gap of exactly the limit splits, which
the batch form leaves together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, *, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(stream: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def session_counts(stream: DataFrame, *, owner: str = "owner", time: str = "ts", gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each owner: bounds and size. Sessions behind the watermark are final."""
    by = timed(stream, time, late).groupBy(F.col(owner), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))
    return by.select(owner, "start", "end", "n")


def window_counts(stream: DataFrame, *, time: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: str = "kind") -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) counts by kind."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return timed(stream, time, late).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def status_counts(stream: DataFrame, column: str = "status") -> DataFrame:
    """Counts by status, for complete mode: every change gives the whole answer."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def job_states(stream: DataFrame, *, retries: int = 3) -> DataFrame:
    """``job_id, status, tries, wait_s`` from job events (``job_id, event, at``), by a state machine per job.

    A failure leads to a retry after 2 s per try (within 1 and 30), the third one
    and a cancellation are final; what comes after a final state is ignored. Nothing
    waits here: ``jobs.timed_jobs`` has the waits and timeouts as timers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, tries = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event"])
        for event in rows["event"]:
            if status in ("completed", "cancelled", "failed"):
                break
            if event == "fail":
                tries += 1
                status = "failed" if tries >= retries else "pending"
            elif event in ("start", "complete", "cancel"):
                status = {"start": "running", "complete": "completed", "cancel": "cancelled"}[event]
        state.update((status, tries))
        wait = max(1, min(30, 2 * tries)) if status == "pending" and tries else 0
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "tries": [tries], "wait_s": [wait]})

    return stream.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, tries int, wait_s int", "status string, tries int", "update", GroupStateTimeout.NoTimeout)


def written(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataStreamWriter:
    """A query into a table in memory that runs until what is there has been read."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
