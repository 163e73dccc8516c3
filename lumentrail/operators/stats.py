"""Counts, roll-ups and health of a catalog, each in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overview(media: DataFrame, tags: DataFrame, faces: DataFrame, favorites: DataFrame) -> DataFrame:
    """One row of counts over the whole catalog; each table is read once."""
    m = media.agg(
        F.count("*").alias("n_media"), F.count_if(F.col("kind") == "photo").alias("n_photos"), F.count_if(F.col("kind") == "video").alias("n_videos"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("lat").alias("n_located"), F.count_if(F.col("blur") >= 0.6).alias("n_blurry"), F.count_if(F.col("quality") >= 0.7).alias("n_good"),
    )
    t = tags.agg(F.count_distinct("label").alias("n_labels"), F.count_distinct("media_id").alias("n_tagged"))
    p = faces.agg(F.count_distinct("person_id").alias("n_people"))
    f = favorites.agg(F.count("*").alias("n_favorites"))
    return m.crossJoin(t).crossJoin(p).crossJoin(f)  # one row each


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def by_month(media: DataFrame) -> DataFrame:
    return media.where("created is not null").groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def by_year(media: DataFrame) -> DataFrame:
    return media.where("created is not null").groupBy(F.year("created").alias("year")).agg(F.count("*").alias("n"))


def by_cell(media: DataFrame) -> DataFrame:
    """Items per grid cell of a hundredth of a degree."""
    return media.where("lat is not null and lng is not null").groupBy(F.round("lat", 2).alias("lat"), F.round("lng", 2).alias("lng")).agg(F.count("*").alias("n"))


def by_status(df: DataFrame, domain: Sequence[str], column: str = "status") -> DataFrame:
    """Counts of every value of a domain, 0 included."""
    spark = df.sparkSession
    names = spark.createDataFrame([(d,) for d in domain], f"{column} string")
    return names.join(df.groupBy(column).agg(F.count("*").alias("c")), column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def coverage(part: Column, whole: Column) -> Column:
    """A ratio; 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def health(jobs: DataFrame, now: Column) -> DataFrame:
    """``n_failed`` of the last 24 h, ``n_stale`` (running for over 15 min) and a class."""
    counted = jobs.agg(
        F.count_if((F.col("status") == "failed") & (F.col("created") >= now - F.expr("INTERVAL 24 HOURS"))).alias("n_failed"),
        F.count_if((F.col("status") == "running") & (F.col("started") < now - F.expr("INTERVAL 15 MINUTES"))).alias("n_stale"),
    )
    return counted.withColumn("class", F.when(F.col("n_failed") > 50, "critical").when((F.col("n_failed") > 10) | (F.col("n_stale") > 0), "degraded").otherwise("healthy"))


def unstuck(jobs: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Running jobs that began over ``minutes`` ago are pending again."""
    stuck = (F.col("status") == "running") & (F.col("started") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumns({"started": F.when(stuck, None).otherwise(F.col("started")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def truncated(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    return df.withColumn(column, F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("..."))).otherwise(F.col(column)))


def queue(jobs: DataFrame, k: int | None = None) -> DataFrame:
    """Pending jobs, highest priority first, then oldest."""
    out = jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created", "job_id")
    return out if k is None else out.limit(k)


def retry_plan(jobs: DataFrame, *, most: int = 3) -> DataFrame:
    """Failed jobs with ``action`` (retry or give up) and the wait before it: 2 s per try so far, within 1 and 30."""
    tries = F.col("retries")
    wait = F.greatest(F.lit(1), F.least(F.lit(30), 2 * (tries + 1)))
    return jobs.where("status = 'failed'").select("job_id", F.when(tries < most, "retry").otherwise("give_up").alias("action"), F.when(tries < most, wait).cast("long").alias("wait_s"))


def timings(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def outdated(media: DataFrame, states: DataFrame, version: str) -> DataFrame:
    """Items never analysed or analysed by another version."""
    return media.join(states.select("media_id", "version"), "media_id", "left").where(F.col("version").isNull() | (F.col("version") != version)).select("media_id")


def best_mean(values: Column, share: float = 0.7) -> Column:
    """Mean of the largest ``share`` (rounded up) of an array."""
    n = F.ceil(F.size(values) * share).cast("int")
    best = F.slice(F.sort_array(values, asc=False), F.lit(1), F.greatest(F.lit(1), n))
    return F.when(F.size(values) > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best))


def keep_top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; what is beyond them goes."""
    return df.orderBy(*order).limit(k)


def best_share_mean(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.7, *, bins: int = 1024) -> DataFrame:
    """``keys..., mean``: of the largest ``share`` (rounded up) of each group's values, for groups of any size.

    Values are counted, then counts are added up in bins of equal width. The bins
    above the cut count whole; only the values of the bin that it goes through are
    sorted, and of equal ones there is one row. Null values don't count.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    reach = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    binned = counted.join(reach, keys).withColumn("bin", at).withColumn("take", F.ceil(F.col("all") * share))
    by_bin = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), F.first("take").alias("take"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = by_bin.withColumn("above", above).withColumn("left", F.col("take") - F.col("above")).where("left > 0")
    whole = cut.where("n <= left").select(*keys, "total", "n")
    open_ = binned.join(cut.where("n > left").select(*keys, "bin", "left"), [*keys, "bin"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = open_.withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("left") - before))).select(*keys, (F.col("v") * F.col("n")).alias("total"), "n")
    return whole.unionByName(part).groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean"))


#: Each sketch has 2^SKETCH registers: a standard error of about 0.8 %.
SKETCH = 14


def daily_sketches(df: DataFrame, day: Column, distinct: Sequence[str]) -> DataFrame:
    """``day, n`` and a sketch of the distinct values of each column: a state that is kept, and merged with that of later rows."""
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n"), *(F.hll_sketch_agg(c, SKETCH).alias(c) for c in distinct))


def merged_sketches(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """States by day of both, as one pass over all rows had made them."""
    columns = [c for c in stored.columns if c not in ("day", "n")]
    return stored.unionByName(incoming).groupBy("day").agg(F.sum("n").alias("n"), *(F.hll_union_agg(c).alias(c) for c in columns))


def sketched_counts(states: DataFrame) -> DataFrame:
    """One row: ``n`` exactly, and the distinct values over all days within the sketches' error."""
    columns = [c for c in states.columns if c not in ("day", "n")]
    return states.agg(F.sum("n").alias("n"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))


def latest(df: DataFrame, keys: Sequence[str], order: str, key: str = "media_id") -> DataFrame:
    """The newest row of each key; of equally new ones that of the smallest ``key``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), key)
    return df.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def diagnostics(tables: dict[str, DataFrame], jobs: DataFrame, analysed: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """``section, name, n, note``: rows of each table, jobs by status, and how many of the first table's items are analysed, with a warning where that is under half of more than ten.

    ``analysed`` has media_id and analysed (a time or null), once for an item.
    """
    first = next(iter(tables))
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit("table").alias("section"), F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    counted = by_status(jobs, statuses).select(F.lit("job").alias("section"), F.col("status").alias("name"), F.col("n").cast("long").alias("n"))
    done = analysed.agg(F.count("analysed").alias("done"), F.max("analysed").alias("last")).crossJoin(tables[first].agg(F.count("*").alias("total")))  # one row each
    share = coverage(F.col("done"), F.col("total"))
    low = F.when((share < 0.5) & (F.col("total") > 10), F.format_string("Analysis coverage is low: %.1f%% (%d/%d photos analyzed)", share * 100, F.col("done"), F.col("total")))
    rows = F.array(
        F.struct(F.lit("analysed").alias("name"), F.col("done").alias("n"), F.date_format("last", "yyyy-MM-dd").alias("note")),
        F.struct(F.lit("not_analysed").alias("name"), (F.col("total") - F.col("done")).alias("n"), F.lit(None).cast("string").alias("note")),
        F.struct(F.lit("coverage").alias("name"), F.floor(share * 1000).cast("long").alias("n"), low.alias("note")),
    )
    told = done.select(F.lit("analysis").alias("section"), F.explode(rows).alias("r")).select("section", "r.*")
    return out.unionByName(counted).withColumn("note", F.lit(None).cast("string")).unionByName(told)


def best_detections(tags: DataFrame, *, key: str = "tag_id") -> DataFrame:
    """The surest detection of each label (in any case) of an item; of equally sure ones the first."""
    best = F.max_by(F.struct(*tags.columns), F.struct("confidence", -F.col(key)))
    return tags.groupBy("media_id", F.lower("label").alias("__label")).agg(best.alias("b")).select("b.*")


def coverage_by(media: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """``what, n, share``: how many items each table covers, and of all."""
    total = media.agg(F.count("*").alias("total"))
    out = None
    for name, df in parts.items():
        found = media.select("media_id").join(df.select("media_id"), "media_id", "left_semi").agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out.crossJoin(F.broadcast(total)).select("what", "n", coverage(F.col("n"), F.col("total")).alias("share"))  # one row


def cube(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and sums of every set of keys; ``level`` tells which ones a row is over (a bit for each that is left out)."""
    return df.cube(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(value).alias(value))


def grouped(df: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """``key, n, first``: how many rows each key has, and the first ``k`` items of it."""
    first = df.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(F.col("__at") <= k)
    items = first.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("first"))
    return df.groupBy(key).agg(F.count("*").alias("n")).join(items, key)


def folded_order(df: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows by a text without regard to case, with ``place``."""
    first = df.orderBy(F.lower(column), column, key).limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.lower(column), column, key)))  # k rows


def over_fetch(limit: int) -> int:
    """How many candidates are fetched for a limit: ten times as many, within 50 and 2000."""
    return max(50, min(2000, 10 * limit))
