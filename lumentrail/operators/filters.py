"""Predicates and set filters over the catalog."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MediaFilter:
    """A structured filter; a field that is None does not filter."""

    date_from: datetime | None = None
    date_to: datetime | None = None
    album: str | None = None
    kind: str | None = None
    make: str | None = None
    model_contains: str | None = None
    min_quality: float | None = None
    max_blur: float | None = None
    min_iso: int | None = None
    max_iso: int | None = None
    min_aperture: float | None = None
    max_aperture: float | None = None
    min_width: int | None = None
    min_height: int | None = None
    has_location: bool | None = None
    location: str | None = None
    labels: tuple[str, ...] = field(default=())
    exclude_labels: tuple[str, ...] = field(default=())
    person: str | None = None
    favorites: bool | None = None

    @classmethod
    def from_json(cls, text: str | None) -> "MediaFilter":
        """A stored album's filter; malformed JSON and unknown fields are no conditions."""
        try:
            stored = json.loads(text or "{}")
        except ValueError:
            stored = {}
        known = {k: v for k, v in stored.items() if k in cls.__dataclass_fields__ and v is not None} if isinstance(stored, dict) else {}
        for k in ("date_from", "date_to"):
            if k in known:
                known[k] = datetime.fromisoformat(known[k])
        for k in ("labels", "exclude_labels"):
            if k in known:
                known[k] = tuple(known[k])
        return cls(**known)

    def to_json(self) -> str:
        return json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in vars(self).items() if v not in (None, ())})

    def refined(self, newer: "MediaFilter") -> "MediaFilter":
        """With the fields that a later query sets in place of these."""
        return replace(self, **{k: v for k, v in vars(newer).items() if v not in (None, ())})


def predicate(f: MediaFilter, nulls: str = "strict") -> Column:
    """The row-wise part of a filter.

    ``strict``: a null fails each comparison. ``lenient``: a null quality is 0,
    a null blur 1, and a null date passes.
    """
    if nulls not in ("strict", "lenient"):
        raise ValueError(nulls)
    lenient = nulls == "lenient"
    quality = F.coalesce("quality", F.lit(0.0)) if lenient else F.col("quality")
    blur = F.coalesce("blur", F.lit(1.0)) if lenient else F.col("blur")

    def dated(c: Column) -> Column:
        return F.col("created").isNull() | c if lenient else c

    parts = {
        "date_from": lambda v: dated(F.col("created") >= F.lit(v).cast("timestamp_ntz")),
        "date_to": lambda v: dated(F.col("created") <= F.lit(v).cast("timestamp_ntz")),
        "album": lambda v: F.col("album") == v,
        "kind": lambda v: F.col("kind") == v,
        "make": lambda v: F.lower("make") == v.lower(),
        "model_contains": lambda v: F.contains(F.lower("model"), F.lit(v.lower())),
        "min_quality": lambda v: quality >= v,
        "max_blur": lambda v: blur <= v,
        "min_iso": lambda v: F.col("iso") >= v,
        "max_iso": lambda v: F.col("iso") <= v,
        "min_aperture": lambda v: F.col("aperture") >= v,
        "max_aperture": lambda v: F.col("aperture") <= v,
        "min_width": lambda v: F.col("width") >= v,
        "min_height": lambda v: F.col("height") >= v,
        "has_location": lambda v: (F.col("lat").isNotNull() & F.col("lng").isNotNull()) == v,
    }
    return reduce(and_, (make(getattr(f, name)) for name, make in parts.items() if getattr(f, name) is not None), F.lit(True))


def structured(media: DataFrame, f: MediaFilter, *, tags: DataFrame | None = None, faces: DataFrame | None = None, favorites: DataFrame | None = None, nulls: str = "strict") -> DataFrame:
    """Rows that pass a filter, its labels, exclusions, person and favorites included."""
    out = media.where(predicate(f, nulls))
    for label in f.labels:
        out = out.join(tags.where(F.lower("label") == label.lower()).select("media_id"), "media_id", "left_semi")
    if f.exclude_labels:
        out = without_labels(out, tags, f.exclude_labels)
    if f.person is not None:
        out = out.join(faces.where(F.col("person_id") == f.person).select("media_id"), "media_id", "left_semi")
    if f.favorites is not None:
        out = out.join(favorites.select("media_id"), "media_id", "left_semi" if f.favorites else "left_anti")
    return out


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """Point look-up."""
    return df.where(F.col(key) == value).limit(1)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "media_id") -> DataFrame:
    """Look-up of many keys at once."""
    return df.join(ids.select(key), key, "left_semi")


def any_label(tags: DataFrame, labels: Sequence[str], least: float = 0.3) -> DataFrame:
    """``media_id, confidence``: the largest confidence over any of the labels."""
    return tags.where(F.col("label").isin(list(labels)) & (F.col("confidence") >= least)).groupBy("media_id").agg(F.max("confidence").alias("confidence"))


def all_labels(tags: DataFrame, labels: Sequence[str], least: float = 0.3) -> DataFrame:
    """Media that carry every label."""
    wanted = sorted(set(labels))
    return tags.where(F.col("label").isin(wanted) & (F.col("confidence") >= least)).groupBy("media_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(wanted)).select("media_id")


def without_labels(media: DataFrame, tags: DataFrame, labels: Sequence[str], least: float = 0.0) -> DataFrame:
    """Media that carry none of the labels. Where nothing carries one, all rows stay."""
    return media.join(tags.where(F.col("label").isin(list(labels)) & (F.col("confidence") >= least)).select("media_id"), "media_id", "left_anti")


def visible(media: DataFrame, *hidden: DataFrame) -> DataFrame:
    """Without trashed, archived, hidden or disliked rows."""
    return reduce(lambda df, h: df.join(h.select("media_id"), "media_id", "left_anti"), hidden, media)


def in_box(df: DataFrame, lat: float, lng: float, radius: float) -> DataFrame:
    """Rows within a square around a position, with ``distance`` in Manhattan degrees and its ``score``."""
    from pyspark.sql.window import Window

    from lumentrail.functions.geo import manhattan_degrees, nearness

    near = df.where(F.col("lat").between(lat - radius, lat + radius) & F.col("lng").between(lng - radius, lng + radius))
    near = near.withColumn("distance", manhattan_degrees(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)))
    furthest = near.agg(F.max("distance").alias("furthest"))
    return near.crossJoin(F.broadcast(furthest)).withColumn("score", nearness(F.col("distance"), F.col("furthest"))).drop("furthest")  # one row


def overlapping(df: DataFrame, start: int, end: int, *, closed: bool = False) -> DataFrame:
    """Intervals that meet another: half-open, or with their ends."""
    return df.where((F.col("start_ms") <= end) & (F.col("end_ms") >= start)) if closed else df.where((F.col("start_ms") < end) & (F.col("end_ms") > start))


def lacks_stage(df: DataFrame, mask: int) -> DataFrame:
    """Rows whose stage bits have none of the mask's."""
    return df.where(F.col("stages").bitwiseAND(mask) == 0)


def expired(trash: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rows to purge: deleted at least ``days`` ago."""
    return trash.where(F.col("deleted") <= now - F.expr(f"INTERVAL {days} DAYS"))


def corrected(tags: DataFrame, corrections: DataFrame) -> DataFrame:
    """Tags without those a user removed: for one item, or (null ``media_id``) everywhere."""
    own = corrections.where("media_id is not null").select("media_id", "label")
    everywhere = corrections.where("media_id is null").select("label")
    return tags.join(own, ["media_id", "label"], "left_anti").join(everywhere, "label", "left_anti")


def timeline_page(media: DataFrame, *, size: int = 80, before: tuple[datetime, int] | None = None, ascending: bool = False) -> DataFrame:
    """A page of the timeline by key: what follows ``before`` (time and id of the last row seen)."""
    if before is not None:
        t, i = F.lit(before[0]).cast("timestamp_ntz"), before[1]
        later = (F.col("created") > t) | ((F.col("created") == t) & (F.col("media_id") > i))
        earlier = (F.col("created") < t) | ((F.col("created") == t) & (F.col("media_id") < i))
        media = media.where(later if ascending else earlier)
    order = [F.col("created").asc(), F.col("media_id").asc()] if ascending else [F.col("created").desc(), F.col("media_id").desc()]
    return media.orderBy(*order).limit(size)


def keep_history(history: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` most frequent queries, newest first among equals."""
    return history.orderBy(F.desc("times"), F.desc("last"), "query").limit(most)


def with_region_vectors_missing(tags: DataFrame, vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """Tags sure enough to deserve a region vector that have none yet."""
    done = vectors.where("region_label is not null").select("media_id", F.col("region_label").alias("label"))
    return tags.where(F.col("confidence") >= least).join(done, ["media_id", "label"], "left_anti")


def without_disliked(media: DataFrame, feedback: DataFrame, query: str) -> DataFrame:
    """Without what was marked irrelevant (``media_id, query, liked``) for a query, however it is spelled; an empty query marks nothing."""
    from lumentrail.functions.text import normalized_query

    wanted = " ".join(query.lower().split())
    if not wanted:
        return media
    disliked = feedback.where((normalized_query(F.col("query")) == wanted) & ~F.col("liked"))
    return media.join(disliked.select("media_id"), "media_id", "left_anti")
