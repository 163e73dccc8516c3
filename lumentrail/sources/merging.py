"""Stored tables that batches are merged into, and tables that change together.

A merged table is Parquet in buckets of its keys' hashes. A batch reads and
rewrites only the buckets that it touches, by dynamic partition overwrite. Each
rewritten bucket carries the batch's number, so a batch that comes again, whole or
after a run that stopped half-way, changes what it has not changed yet and no
more: sums are added once.

Tables that belong together are written as versions of their own and become
visible by one row of a manifest, which comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumentrail.operators.lineage import settle

BUCKET, BATCH = "__bucket", "__batch"
Combine = Callable[[DataFrame, DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """A merged table's rows."""
    return spark.read.parquet(path).drop(BUCKET, BATCH)


def merge(path: str, incoming: DataFrame, keys: Sequence[str], batch: int, combine: Combine, *, buckets: int = 64) -> list[int]:
    """Merges a batch into the table at ``path`` and returns the buckets that were rewritten.

    ``combine(stored, incoming)`` gives the rows to store for the keys of both, as
    ``upsert`` and ``upsert_edges`` do. Batches come in the order of their numbers.
    Buckets of any size are read and written by as many tasks as Spark makes of them;
    at most ``buckets`` numbers reach the driver.
    """
    spark, bucket = incoming.sparkSession, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = settle(incoming.withColumn(BUCKET, bucket))
    open_ = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    stored = None
    if exists(spark, path):
        stored = spark.read.parquet(path)
        done = stored.where(F.col(BUCKET).isin(open_)).groupBy(BUCKET).agg(F.max(BATCH).alias("b")).where(F.col("b") >= batch)
        open_ = sorted(set(open_) - {r[0] for r in done.select(BUCKET).collect()})
    if not open_:
        return []
    mine = rows.where(F.col(BUCKET).isin(open_)).drop(BUCKET)
    before = stored.where(F.col(BUCKET).isin(open_)).drop(BUCKET, BATCH) if stored is not None else mine.limit(0)
    after = settle(combine(before, mine).withColumn(BATCH, F.lit(batch).cast("long")).withColumn(BUCKET, bucket))  # a path can't be read while it is written
    after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return open_


def merging(stream: DataFrame, path: str, keys: Sequence[str], combine: Combine, checkpoint: str, *, buckets: int = 64) -> DataStreamWriter:
    """A stream whose batches are merged into the table at ``path``, each once."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: merge(path, rows, keys, batch, combine, buckets=buckets) and None)
    return writer.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True)


def publish(root: str, tables: Mapping[str, DataFrame], version: int) -> bool:
    """Replaces all tables under ``root`` together; whether it did (a version that is already there stays as it is).

    A run that stops before the manifest's row leaves the old tables visible and is
    repeated whole.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = f"{root}/manifest"
    if exists(spark, manifest) and spark.read.parquet(manifest).where(F.col("version") >= version).limit(1).count():
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.array(*map(F.lit, sorted(tables))).alias("tables")).coalesce(1).write.mode("append").parquet(manifest)
    return True


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version under ``root``."""
    last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{root}/{name}/version={last['version']}") for name in last["tables"]}
