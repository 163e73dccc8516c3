"""Lineage cuts for iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

#: Whether a plan's shuffle files go when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What a table shuffles that is written meanwhile is deleted with the end of its job, not with the driver's next collection of garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's shared checkpoint folder.

    A session of one machine that names none gets a folder of its own; on a
    cluster, where executors can't read each other's disks, that is an error.
    What ``df`` shuffled is deleted with the end of the job: nothing reads it again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with unshuffled(spark):
        return df.select("*").checkpoint(eager=True)  # a plan of its own is made with the setting


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, set if it was not."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumentrail-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder, for a table that a job writes and reads again."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> bool:
    """Deletes a table that a job is done with; whether there was one."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    return gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


#: Rows of a task, about, beyond which tables are dealt to tasks by their rows.
TASK_ROWS = 500_000


def tasks(*tables: DataFrame) -> int:
    """Tasks among which to deal tables, by the rows of the files that the largest reads; 0 where one task is enough or one reads no Parquet files."""
    rows = []
    for df in tables:
        files = [unquote(f) for f in df.inputFiles()]
        if not files or not all(f.endswith(".parquet") for f in files):
            return 0
        rows.append(df.sparkSession.read.parquet(*files).count())
    n = -(-max(rows) // TASK_ROWS)
    return max(n, tables[0].sparkSession.sparkContext.defaultParallelism) if n > 1 else 0


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to ``n`` tasks, if not given to as many as ``tasks`` finds, so that a task's share doesn't grow with the input.

    The number is given to Spark in every case but 0: what a shuffle of the session's own makes of its
    partitions depends on their compressed bytes, of which short rows need very few.
    """
    n = tasks(df) if n is None else n
    return df.repartition(n, *keys) if n else df
