"""Catalog tables: schemas, readers and the writes a mutable store would do in place.

A write is a function from the stored and the incoming rows to the rows to store;
none reads the clock or collects rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.operators.lineage import spread, tasks

#: Tables of the catalog as DDL.
SCHEMAS: dict[str, str] = {
    "media": "media_id string, created timestamp_ntz, modified timestamp_ntz, album string, kind string, width long, height long, iso long, aperture double, make string, model string, lat double, lng double, quality double, blur double, dominant_color int, bytes long, content_hash string, perceptual_hash string",
    "faces": "id string, media_id string, person_id string, box struct<left:double,top:double,width:double,height:double>, confidence double, vector array<float>",
    "tags": "id string, media_id string, label string, box struct<left:double,top:double,width:double,height:double>, confidence double",
    "texts": "id string, media_id string, text string, confidence double, box struct<left:double,top:double,width:double,height:double>",
    "vectors": "id string, media_id string, model string, vector array<float>, region_label string, region_box struct<left:double,top:double,width:double,height:double>",
    "people": "person_id string, display_name string, status string, created timestamp_ntz, updated timestamp_ntz, cover string",
    "jobs": "job_id string, media_id string, kind string, status string, priority int, progress double, retries int, created timestamp_ntz, started timestamp_ntz, finished timestamp_ntz, error string",
    "entities": "id string, type string, external_id string, name string, created timestamp_ntz, updated timestamp_ntz",
    "edges": "relation string, source string, target string, confidence double, weight double, evidence string, updated timestamp_ntz",
    "segments": "video_id string, start_ms long, end_ms long, people array<string>, labels array<string>, ocr_text string, confidence double, vector array<double>",
    "history": "query string, times long, last timestamp_ntz",
    "albums": "album_id string, category string, query string",
}


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table under its fixed schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def write(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; ``overwrite`` is the replace-all of a derived table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of path, time, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Incoming rows replace stored ones of the same key; of several the last by ``order``."""
    both = stored.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("__in"), *[c.desc() for c in order])
    return both.withColumn("__at", F.row_number().over(newest)).where("__at = 1").drop("__in", "__at")


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stored rows stay; of incoming ones the first by ``order`` comes in where its key is new."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = incoming.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti").select(stored.columns))


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by (relation, source, target): largest confidence, summed weight, newest evidence."""
    keys = ["relation", "source", "target"]
    return stored.unionByName(incoming).groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.sum("weight").alias("weight"), F.max_by("evidence", F.struct("updated", "evidence")).alias("evidence"), F.max("updated").alias("updated")
    )


def delete_cascade(tables: Mapping[str, DataFrame], gone: DataFrame, key: str = "media_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def scan_diff(source: DataFrame, index: DataFrame) -> DataFrame:
    """``media_id, change`` (new, modified, deleted) of a source against its index; both have ``media_id, modified``."""
    both = source.select("media_id", F.col("modified").alias("s")).join(index.select("media_id", F.col("modified").alias("i")), "media_id", "full_outer")
    change = F.when(F.col("i").isNull(), "new").when(F.col("s").isNull(), "deleted").when(F.col("s") > F.col("i"), "modified")
    return both.select("media_id", change.alias("change")).where("change is not null")


def reconcile(catalog: DataFrame, device: DataFrame) -> DataFrame:
    """``media_id, state``: orphaned (in the catalog alone) or missing (on the device alone)."""
    n = tasks(catalog, device)
    catalog, device = (spread(t.select("media_id"), "media_id", n=n) for t in (catalog, device))
    lost = catalog.select("media_id").distinct().join(device.select("media_id"), "media_id", "left_anti").select("media_id", F.lit("orphaned").alias("state"))
    new = device.select("media_id").distinct().join(catalog.select("media_id"), "media_id", "left_anti").select("media_id", F.lit("missing").alias("state"))
    return lost.unionByName(new)


def exif_time(text: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss`` as a time without zone; null for anything else."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def exif_ratio(text: Column) -> Column:
    """``a/b`` or a plain number as a double; null for anything else."""
    parts = F.split(text, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, top).otherwise(F.try_divide(top, bottom))


ALBUM_QUERY = "text string, people array<string>, labels array<string>, exclude_labels array<string>, album string, kind string, date_from timestamp_ntz, date_to timestamp_ntz, min_quality double, max_blur double, has_location boolean, favorites boolean, screenshots boolean"


def album_query(json: Column) -> Column:
    """A stored album query; malformed JSON is an empty query."""
    return F.coalesce(F.from_json(json, ALBUM_QUERY, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), ALBUM_QUERY))


def recent_messages(messages: DataFrame, now: Column, *, most: int = 100, days: int = 7) -> DataFrame:
    """The newest ``most`` messages (``message_id, sent``) of at most ``days`` days."""
    return messages.where(F.col("sent") >= now - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("sent"), F.desc("message_id")).limit(most)
