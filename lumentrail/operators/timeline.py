"""Sessions, gaps, hotspots, events and trips on a time-ordered series.

All of it is windows by owner: one sort of each owner's rows, and no self-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.functions.geo import degrees_apart, haversine_km
from lumentrail.functions.time import micros_between, whole_hours

HOUR = 3_600_000_000


def _series(owner: Sequence[str], time: str, key: str):
    return Window.partitionBy(*owner).orderBy(time, key)


def sessions(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts", key: str = "media_id", gap_hours: float = 4, inclusive: bool = False) -> DataFrame:
    """Adds ``session``, from 0 by owner: a new one after a gap of more than ``gap_hours`` (or, ``inclusive``, of that much)."""
    w = _series(owner, time, key)
    gap = micros_between(F.lag(time).over(w), F.col(time))
    limit = int(gap_hours * HOUR)
    new = F.coalesce(gap >= limit if inclusive else gap > limit, F.lit(False)).cast("int")
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def adaptive_sessions(df: DataFrame, **options) -> DataFrame:
    """The threshold is the largest gap of 1 to 24 whole hours, which comes to a split at gaps of 25 hours and more."""
    return sessions(df, gap_hours=25, inclusive=True, **options)


def session_bounds(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts") -> DataFrame:
    return df.groupBy(*owner, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def merged_sessions(bounds: DataFrame, *, owner: Sequence[str] = ("owner",), gap_hours: float = 2) -> DataFrame:
    """Adjacent sessions at most ``gap_hours`` apart as one."""
    w = Window.partitionBy(*owner).orderBy("start", "session")
    gap = micros_between(F.lag("end").over(w), F.col("start"))
    new = F.coalesce(gap > int(gap_hours * HOUR), F.lit(False)).cast("int")
    grouped = bounds.withColumn("__new", new).withColumn("merged", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*owner, "merged").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def split_oversize(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts", key: str = "media_id", most: int = 200) -> DataFrame:
    """Adds ``chunk``: runs of at most ``most`` rows of a session."""
    w = Window.partitionBy(*owner, "session").orderBy(time, key)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / most).cast("int"))


def gaps(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts", key: str = "media_id", least_hours: float = 6) -> DataFrame:
    """Pairs of consecutive rows at least ``least_hours`` apart: start, end, duration in microseconds."""
    previous = F.lag(time).over(_series(owner, time, key))
    rows = df.select(*owner, previous.alias("start"), F.col(time).alias("end"))
    return rows.withColumn("micros", micros_between(F.col("start"), F.col("end"))).where(F.col("micros") >= int(least_hours * HOUR))


def moves(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "created", key: str = "media_id") -> DataFrame:
    """Each row that has a position with its owner's one before (``previous``) and the way between them (``km``)."""
    w = _series(owner, time, key)
    placed = df.where("lat is not null and lng is not null")
    rows = placed.select("*", F.lag(key).over(w).alias("previous"), F.lag("lat").over(w).alias("__lat"), F.lag("lng").over(w).alias("__lng")).where("previous is not null")
    return rows.withColumn("km", haversine_km(F.col("__lat"), F.col("__lng"), F.col("lat"), F.col("lng"))).drop("__lat", "__lng")


def hotspots(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts", minutes: int = 30, least: int = 3) -> DataFrame:
    """Rows with at least ``least`` rows within less than ``minutes`` of them, and that count."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    reach = minutes * 60_000_000 - 1
    w = Window.partitionBy(*owner).orderBy("__t").rangeBetween(-reach, reach)
    return df.withColumn("__t", micros).withColumn("n_near", F.count("*").over(w)).drop("__t").where(F.col("n_near") >= least)


def events(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "created", key: str = "media_id", hours: int = 4, degrees: float = 0.005, least: int = 2) -> DataFrame:
    """Rows with ``event``: a new one after ``hours`` whole hours or a move of more than ``degrees`` (where both rows have a position); events of fewer than ``least`` rows go."""
    w = _series(owner, time, key)
    late = whole_hours(F.lag(time).over(w), F.col(time)) >= hours
    moved = (F.abs(F.col("lat") - F.lag("lat").over(w)) > degrees) | (F.abs(F.col("lng") - F.lag("lng").over(w)) > degrees)
    new = (F.coalesce(late, F.lit(False)) | F.coalesce(moved, F.lit(False))).cast("int")
    marked = df.withColumn("__new", new).withColumn("event", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return marked.withColumn("__n", F.count("*").over(Window.partitionBy(*owner, "event"))).where(F.col("__n") >= least).drop("__n")


def event_summary(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "created") -> DataFrame:
    """One row per event: bounds, size, centroid of the positions there are, and confidence."""
    hours = F.least(whole_hours(F.min(time), F.max(time)) / 8.0, F.lit(1.0))
    trust = 0.4 * F.least(F.count("*") / 10.0, F.lit(1.0)) + 0.6 * hours
    return df.groupBy(*owner, "event").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.greatest(F.lit(0.3), F.least(F.lit(1.0), trust)).alias("confidence"),
    )


def spread(lat: str = "lat", lng: str = "lng") -> Column:
    """Aggregate: the larger range of the two coordinates; 0 without positions."""
    return F.coalesce(F.greatest(F.max(lat) - F.min(lat), F.max(lng) - F.min(lng)), F.lit(0.0))


def trips(events_: DataFrame, *, owner: Sequence[str] = ("owner",), home: tuple[float, float] | None = None, least: int = 5, from_home: float = 0.5, least_spread: float = 0.25) -> DataFrame:
    """Events (rows with ``event``) that are trips: enough rows, and far from home or, without one, widely spread."""
    by = events_.groupBy(*owner, "event").agg(F.min("created").alias("start"), F.max("created").alias("end"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), spread().alias("spread"))
    wide = F.col("spread") >= least_spread
    away = wide if home is None else degrees_apart(F.col("lat"), F.col("lng"), F.lit(home[0]), F.lit(home[1])) >= from_home
    return by.where((F.col("n") >= least) & F.coalesce(away, F.lit(False)))


def merged_trips(trips_: DataFrame, *, owner: Sequence[str] = ("owner",), days: int = 2) -> DataFrame:
    """Trips at most ``days`` days apart as one; the end so far is the latest of those before."""
    before = Window.partitionBy(*owner).orderBy("start", "event").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*owner).orderBy("start", "event").rowsBetween(Window.unboundedPreceding, 0)
    gap = micros_between(F.max("end").over(before), F.col("start"))
    rows = trips_.withColumn("__new", F.coalesce(gap > days * 24 * HOUR, F.lit(False)).cast("int")).withColumn("trip", F.sum("__new").over(upto))
    return rows.groupBy(*owner, "trip").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def band_pairs(df: DataFrame, *, time: str = "start", key: str = "event", within_hours: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (of the same ``by``, say an owner) less than ``within_hours`` apart, each once: an equi-join on time buckets, not a cross join."""
    width = within_hours * HOUR
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    left = df.select(*by, F.col(key).alias("a"), micros.alias("ta"), F.explode(F.array(*[F.floor(micros / width) + d for d in (0, 1)])).alias("bucket"))
    right = df.select(*by, F.col(key).alias("b"), micros.alias("tb"), F.floor(micros / width).alias("bucket"))
    ordered = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))
    return left.join(right, [*by, "bucket"]).where(ordered & (F.col("tb") - F.col("ta") < width)).select(*by, "a", "b", (F.col("tb") - F.col("ta")).alias("micros"))


def rate_limited(df: DataFrame, *, owner: Sequence[str] = ("owner",), time: str = "ts", seconds: int = 60, most: int = 3) -> DataFrame:
    """Adds ``n_recent`` (rows of the last ``seconds``, this one included) and ``allowed``."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    w = Window.partitionBy(*owner).orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("__t", micros).withColumn("n_recent", F.count("*").over(w)).withColumn("allowed", F.col("n_recent") <= most).drop("__t")
