"""Registered queries over the catalog views, each with its SQL twin where SQL can express it.

Doubles that depend on the order of a sum are rounded to six places on both
sides; every ordering ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.functions import box, geo, text, time, vector
from lumentrail.operators import albums, clusters, dedup, faceindex, filters, graph, retrieval, stats, timeline, video
from lumentrail.operators.lineage import settle
from lumentrail.plans.parser import parse, parsed_column
from lumentrail.sources import tables
from lumentrail.sources.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2001, 8, 2)
NOW_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
STREAM_NOW = datetime(2024, 1, 31)
STREAM_NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

HAVERSINE_SQL = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def stream_now():
    return F.lit(STREAM_NOW).cast("timestamp_ntz")


def query(*names: str, sql: str | None = None):
    """Registers a function of the named views; ``sql`` is its twin over the same views."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *names)
        return f

    return register


# Search and ranking.


def _query_vector(vectors: DataFrame) -> DataFrame:
    """One row: the vector of item 7."""
    return F.broadcast(vectors.where("media_id = 7").limit(1).select(F.col("vector").alias("__q")))


def _semantic(vectors: DataFrame) -> DataFrame:
    """Each item's best similarity to item 7."""
    both = vectors.crossJoin(_query_vector(vectors))  # one row
    return both.groupBy("media_id").agg(F.max(vector.cosine(F.col("vector"), F.col("__q"))).alias("semantic"))


COSINE = "list_cosine_similarity(v.vector::DOUBLE[], q.vector::DOUBLE[])"
SEMANTIC_SQL = f"sem AS (SELECT v.media_id, max({COSINE}) AS semantic FROM vectors v, vectors q WHERE q.media_id = 7 GROUP BY v.media_id)"
TEXT_SQL = "txt AS (SELECT media_id, max((CAST(contains(lower(text), 'the') AS DOUBLE) + CAST(contains(lower(text), 'idiot') AS DOUBLE)) / 2) AS text_score FROM texts WHERE contains(lower(text), 'the') OR contains(lower(text), 'idiot') GROUP BY media_id)"
HYBRID_SQL = "hyb AS (SELECT media_id, coalesce(semantic, 0) AS semantic, coalesce(text_score, 0) AS text_score, 0.7 * coalesce(semantic, 0) + 0.3 * coalesce(text_score, 0) AS score FROM sem FULL JOIN txt USING (media_id) WHERE media_id IN (SELECT media_id FROM media))"
RANK_SQL = f"""greatest(0, least(1, 0.5 * h.semantic + 0.15 * CAST(m.media_id IN (SELECT media_id FROM favorites) AS DOUBLE)
  + 0.1 * (CASE WHEN date_diff('day', m.created, {NOW_SQL}) <= 0 THEN 1.0 ELSE exp(-date_diff('day', m.created, {NOW_SQL}) / 30.0) END)
  + 0.08 * coalesce(m.quality, 0.5) + 0.07 * least(1.0, ln(1 + m.views) / ln(101)) + 0.05 * 0.5))"""


def _details(media: DataFrame, favorites: DataFrame) -> DataFrame:
    marked = favorites.select("media_id", F.lit(True).alias("favorite"))
    return media.select("media_id", "created", "quality", "views", "album").join(marked, "media_id", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False))).withColumn("object_score", F.lit(0.0))


@query(
    "vectors", "texts", "media", "favorites",
    sql=f"""WITH {SEMANTIC_SQL}, {TEXT_SQL}, {HYBRID_SQL},
    rough AS (SELECT * FROM hyb ORDER BY score DESC, media_id LIMIT 60),
    done AS (SELECT h.media_id, h.score, {RANK_SQL} AS rank_score FROM rough h JOIN media m USING (media_id))
    SELECT media_id, round(score, 6) AS score, round(rank_score, 6) AS rank_score FROM done ORDER BY done.rank_score DESC, media_id LIMIT 20""",
)
def hybrid_search(vectors, texts, media, favorites):
    scores = retrieval.hybrid(_semantic(vectors), retrieval.text_scores(texts, "the idiot"), media)
    best = retrieval.two_phase(scores, _details(media, favorites), 20, now=now())
    return best.select("media_id", F.round("score", 6).alias("score"), F.round("rank_score", 6).alias("rank_score"))


@query("vectors", sql=f"SELECT v.media_id, round(max({COSINE}), 6) AS score FROM vectors v, vectors q WHERE q.media_id = 7 AND v.media_id <> 7 GROUP BY v.media_id ORDER BY max({COSINE}) DESC, v.media_id LIMIT 15")
def similar_items(vectors):
    return retrieval.similar_to(vectors, 7, 15).select("media_id", F.round("score", 6).alias("score"))


@query("texts", "media", sql=f"WITH {TEXT_SQL} SELECT media_id, round(0.3 * text_score, 6) AS score FROM txt WHERE media_id IN (SELECT media_id FROM media) ORDER BY text_score DESC, media_id LIMIT 25")
def text_only_search(texts, media):
    return retrieval.top(retrieval.hybrid(None, retrieval.text_scores(texts, "the idiot"), media), 25).select("media_id", F.round("score", 6).alias("score"))


@query("vectors", "media", "faces", sql=f"WITH {SEMANTIC_SQL} SELECT m.media_id, round(coalesce(s.semantic, 0.5), 6) AS score FROM media m LEFT JOIN sem s USING (media_id) WHERE m.media_id IN (SELECT media_id FROM faces WHERE person_id = 3)")
def person_and_semantic_search(vectors, media, faces):
    return retrieval.person_search(media, faces, 3, _semantic(vectors)).select("media_id", F.round("score", 6).alias("score"))


@query("media", "faces", sql="SELECT media_id, CAST(1 AS DOUBLE) AS score FROM media WHERE media_id IN (SELECT media_id FROM faces WHERE person_id = 3)")
def person_search(media, faces):
    return retrieval.person_search(media, faces, 3)


@query("vectors", "media", sql=f"WITH {SEMANTIC_SQL} SELECT m.media_id, round(0.15 + 0.7 * coalesce(s.semantic, 0), 6) AS score FROM media m LEFT JOIN sem s USING (media_id) WHERE lat IS NOT NULL AND lng IS NOT NULL")
def location_search(vectors, media):
    return retrieval.location_search(media, _semantic(vectors)).select("media_id", F.round("score", 6).alias("score"))


@query("tags", "media", sql="SELECT media_id, max(confidence) AS score FROM tags WHERE label IN ('AF', 'RF') AND confidence >= 0.3 AND media_id IN (SELECT media_id FROM media) GROUP BY media_id")
def object_search(tags, media):
    return filters.any_label(tags, ["AF", "RF"]).join(media.select("media_id"), "media_id", "left_semi").select("media_id", F.col("confidence").alias("score"))


@query(
    "vectors", "texts", "media",
    sql=f"WITH {SEMANTIC_SQL}, {TEXT_SQL}, {HYBRID_SQL} SELECT media_id, array_to_string(list_filter([CASE WHEN text_score > 0 THEN 'ocr' END, CASE WHEN semantic >= 0.25 THEN 'semantic' END], lambda x: x IS NOT NULL), ',') AS matched FROM hyb",
)
def match_signals(vectors, texts, media):
    scores = retrieval.hybrid(_semantic(vectors), retrieval.text_scores(texts, "the idiot"), media)
    rows = retrieval.signals(scores.withColumn("object_score", F.lit(0.0)).withColumn("region", F.lit(None).cast("string")))
    return rows.select("media_id", F.array_join("matched", ",").alias("matched"))


@query("turns", sql="SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query, count(*) AS times FROM turns GROUP BY 1 ORDER BY times DESC, query LIMIT 100")
def query_log(turns):
    rows = turns.select(text.normalized_query(F.col("text")).alias("query"), F.lit(STREAM_NOW).alias("at"))
    empty = rows.limit(0).select("query", F.lit(0).cast("long").alias("times"), F.col("at").alias("last"))
    return retrieval.logged_queries(empty, rows).select("query", "times")


@query("turns", sql="WITH h AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query, count(*) AS times FROM turns GROUP BY 1) SELECT query, times FROM h WHERE starts_with(query, 'the') ORDER BY times DESC, query LIMIT 5")
def query_suggestions(turns):
    h = turns.groupBy(text.normalized_query(F.col("text")).alias("query")).agg(F.count("*").alias("times")).withColumn("last", F.lit(STREAM_NOW))
    return retrieval.suggestions(h, "the").select("query", "times")


# Filters.

FROM_SQL, TO_SQL = "TIMESTAMP '1997-01-01 00:00:00'", "TIMESTAMP '2000-06-30 23:59:59'"
SPEC = filters.MediaFilter(date_from=datetime(1997, 1, 1), date_to=datetime(2000, 6, 30, 23, 59, 59), kind="photo", min_quality=0.3, max_blur=0.6, has_location=True)


@query("media", sql=f"SELECT media_id FROM media WHERE created >= {FROM_SQL} AND created <= {TO_SQL} AND kind = 'photo' AND quality >= 0.3 AND blur <= 0.6 AND lat IS NOT NULL AND lng IS NOT NULL")
def strict_filter(media):
    return filters.structured(media, SPEC).select("media_id")


@query("media", sql=f"SELECT media_id FROM media WHERE (created IS NULL OR created >= {FROM_SQL}) AND (created IS NULL OR created <= {TO_SQL}) AND kind = 'photo' AND coalesce(quality, 0) >= 0.3 AND coalesce(blur, 1) <= 0.6 AND lat IS NOT NULL AND lng IS NOT NULL")
def lenient_filter(media):
    return filters.structured(media, SPEC, nulls="lenient").select("media_id")


@query(
    "media", "tags", "faces", "favorites",
    sql="SELECT media_id FROM media WHERE kind = 'photo' AND media_id IN (SELECT media_id FROM tags WHERE lower(label) = 'nf' OR lower(label) = 'no') AND media_id IN (SELECT media_id FROM tags WHERE lower(label) = 'no') AND media_id NOT IN (SELECT media_id FROM tags WHERE label = 'RF') AND media_id IN (SELECT media_id FROM favorites)",
)
def full_filter(media, tags, faces, favorites):
    return filters.structured(media, filters.MediaFilter(kind="photo", labels=("NO",), exclude_labels=("RF",), favorites=True), tags=tags, faces=faces, favorites=favorites).select("media_id")


@query("tags", sql="SELECT media_id FROM tags WHERE label IN ('AF', 'NO') AND confidence >= 0.3 GROUP BY media_id HAVING count(DISTINCT label) = 2")
def all_labels(tags):
    return filters.all_labels(tags, ["AF", "NO"])


@query("media", "tags", sql="SELECT media_id FROM media WHERE media_id NOT IN (SELECT media_id FROM tags WHERE label IN ('AF'))")
def excluded_labels(media, tags):
    return filters.without_labels(media, tags, ["AF"]).select("media_id")


@query("media", "tags", sql="SELECT media_id FROM media")
def excluded_by_nobody(media, tags):
    """A label that nothing carries excludes nothing."""
    return filters.without_labels(media, tags, ["no such label"]).select("media_id")


@query("media", "trash", "hidden", sql="SELECT media_id, created FROM media WHERE media_id NOT IN (SELECT media_id FROM trash) AND media_id NOT IN (SELECT media_id FROM hidden) ORDER BY created DESC, media_id DESC LIMIT 80")
def timeline_page(media, trash, hidden):
    return filters.timeline_page(filters.visible(media, trash, hidden)).select("media_id", "created")


@query("media", sql="SELECT media_id, created FROM media WHERE created < TIMESTAMP '1999-01-01 00:00:00' OR (created = TIMESTAMP '1999-01-01 00:00:00' AND media_id < 5000) ORDER BY created DESC, media_id DESC LIMIT 80")
def timeline_next_page(media):
    return filters.timeline_page(media, before=(datetime(1999, 1, 1), 5000)).select("media_id", "created")


@query(
    "media",
    sql="WITH near AS (SELECT media_id, abs(lat - 10) + abs(lng - 20) AS distance FROM media WHERE lat BETWEEN -10 AND 30 AND lng BETWEEN 0 AND 40) SELECT media_id, round(distance, 6) AS distance, round(CASE WHEN (SELECT max(distance) FROM near) > 0 THEN 1 - distance / (2 * (SELECT max(distance) FROM near)) ELSE 1 END, 6) AS score FROM near",
)
def near_position(media):
    return filters.in_box(media, 10.0, 20.0, 20.0).select("media_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("segments", sql="SELECT video_id, start_ms, end_ms, label FROM segments WHERE start_ms < 9000 AND end_ms > 5000")
def segments_in_range(segments):
    return filters.overlapping(segments, 5000, 9000).select("video_id", "start_ms", "end_ms", "label")


@query("segments", sql="SELECT video_id, start_ms, end_ms, label FROM segments WHERE start_ms <= 9000 AND end_ms >= 5000")
def segments_meeting_range(segments):
    """With their ends: touching is meeting."""
    return filters.overlapping(segments, 5000, 9000, closed=True).select("video_id", "start_ms", "end_ms", "label")


@query("media", sql="SELECT media_id FROM media WHERE stages & 5 = 0")
def missing_stages(media):
    return filters.lacks_stage(media, 5).select("media_id")


@query("trash", sql=f"SELECT media_id, greatest(0, least(30, 30 - date_diff('day', deleted, {NOW_SQL}))) AS days_left FROM trash")
def trash_days_left(trash):
    return trash.select("media_id", time.days_left(F.col("deleted"), now()).cast("long").alias("days_left"))


@query("trash", sql=f"SELECT media_id FROM trash WHERE deleted <= {NOW_SQL} - INTERVAL 30 DAY")
def expired_trash(trash):
    return filters.expired(trash, now()).select("media_id")


@query("texts", sql="SELECT media_id FROM texts WHERE contains(lower(text), '%')")
def literal_wildcards(texts):
    """A percent sign is itself and matches nothing else."""
    return texts.where(text.contains_folded(F.col("text"), "%")).select("media_id")


@query("people", sql="SELECT person_id, name FROM people WHERE lower(name) = lower('SUPPLIER#000000007') AND status = 'active'")
def person_by_name(people):
    return people.where((F.lower("name") == "supplier#000000007") & (F.col("status") == "active")).select("person_id", "name")


@query("people", sql="SELECT person_id, display_name IS NULL AS unknown FROM people")
def named_people(people):
    return people.select("person_id", F.col("display_name").isNull().alias("unknown"))


# Counts.


@query(
    "media", "tags", "faces", "favorites",
    sql="""SELECT (SELECT count(*) FROM media) AS n_media, (SELECT count(*) FROM media WHERE kind = 'photo') AS n_photos, (SELECT count(*) FROM media WHERE kind = 'video') AS n_videos,
    (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM media) AS bytes, (SELECT count(lat) FROM media) AS n_located, (SELECT count(*) FROM media WHERE blur >= 0.6) AS n_blurry, (SELECT count(*) FROM media WHERE quality >= 0.7) AS n_good,
    (SELECT count(DISTINCT label) FROM tags) AS n_labels, (SELECT count(DISTINCT media_id) FROM tags) AS n_tagged, (SELECT count(DISTINCT person_id) FROM faces) AS n_people, (SELECT count(*) FROM favorites) AS n_favorites""",
)
def overview(media, tags, faces, favorites):
    return stats.overview(media, tags, faces, favorites)


@query("tags", sql="SELECT label, count(*) AS n FROM tags GROUP BY label ORDER BY n DESC, label LIMIT 4")
def top_labels(tags):
    return stats.top_values(tags, "label", 4)


@query("media", sql="SELECT strftime(created, '%Y-%m') AS month, count(*) AS n FROM media GROUP BY 1")
def count_by_month(media):
    return stats.by_month(media)


@query("media", sql="SELECT CAST(year(created) AS INTEGER) AS year, count(*) AS n FROM media GROUP BY 1")
def count_by_year(media):
    return stats.by_year(media)


@query("media", sql="SELECT round(lat, 2) AS lat, round(lng, 2) AS lng, count(*) AS n FROM media WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2")
def count_by_cell(media):
    return stats.by_cell(media)


@query("jobs", sql="SELECT d.status, coalesce(c.n, 0) AS n FROM (VALUES ('pending'), ('running'), ('failed'), ('completed'), ('cancelled'), ('paused')) d(status) LEFT JOIN (SELECT status, count(*) AS n FROM jobs GROUP BY status) c USING (status)")
def jobs_by_status(jobs):
    return stats.by_status(jobs, ["pending", "running", "failed", "completed", "cancelled", "paused"])


@query(
    "jobs",
    sql=f"WITH c AS (SELECT count(*) FILTER (WHERE status = 'failed' AND created >= {STREAM_NOW_SQL} - INTERVAL 24 HOUR) AS n_failed, count(*) FILTER (WHERE status = 'running' AND started < {STREAM_NOW_SQL} - INTERVAL 15 MINUTE) AS n_stale FROM jobs) SELECT n_failed, n_stale, CASE WHEN n_failed > 50 THEN 'critical' WHEN n_failed > 10 OR n_stale > 0 THEN 'degraded' ELSE 'healthy' END AS class FROM c",
)
def job_health(jobs):
    return stats.health(jobs, stream_now())


@query("jobs", sql="SELECT job_id, priority, created FROM jobs WHERE status = 'pending' ORDER BY priority DESC, created, job_id LIMIT 50")
def job_queue(jobs):
    return stats.queue(jobs, 50).select("job_id", "priority", "created")


@query("jobs", sql=f"SELECT job_id, CASE WHEN status = 'running' AND started < {STREAM_NOW_SQL} - INTERVAL 10 MINUTE THEN 'pending' ELSE status END AS status FROM jobs")
def jobs_unstuck(jobs):
    return stats.unstuck(jobs, stream_now()).select("job_id", "status")


@query("jobs", sql="SELECT job_id, CASE WHEN retries < 3 THEN 'retry' ELSE 'give_up' END AS action, CASE WHEN retries < 3 THEN greatest(1, least(30, 2 * (retries + 1))) END AS wait_s FROM jobs WHERE status = 'failed'")
def job_retries(jobs):
    return stats.retry_plan(jobs)


@query("timeline", sql="SELECT kind, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM timeline GROUP BY kind")
def timing_stats(timeline):
    return stats.timings(timeline, "kind", "value").select("kind", "n", "least", "most", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


@query("faces", sql="SELECT person_id, count(*) AS n FROM faces GROUP BY person_id ORDER BY n DESC, person_id LIMIT 30")
def faces_per_person(faces):
    return stats.top_values(faces, "person_id", 30)


@query("media", sql="SELECT album, round(avg(q), 6) AS quality FROM (SELECT album, coalesce(quality, 0.5) AS q, row_number() OVER (PARTITION BY album ORDER BY coalesce(quality, 0.5) DESC) AS pos, count(*) OVER (PARTITION BY album) AS n FROM media) WHERE pos <= ceil(n * CAST(0.7 AS DOUBLE)) GROUP BY album")
def best_share_quality(media):
    known = media.select("album", F.coalesce("quality", F.lit(0.5)).alias("quality"))
    return stats.best_share_mean(known, ["album"], "quality").select("album", F.round("mean", 6).alias("quality"))


@query("timeline", sql="SELECT kind, media_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, media_id) AS pos FROM timeline) WHERE pos = 1")
def latest_by_kind(timeline):
    return stats.latest(timeline, ["kind"], "ts").select("kind", "media_id", "ts")


@query("media", sql="SELECT kind, album, CAST(grouping(kind) * 2 + grouping(album) AS BIGINT) AS level, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM media GROUP BY CUBE (kind, album)")
def cube_counts(media):
    return stats.cube(media, ["kind", "album"], "bytes")


@query("jobs", sql="SELECT status, count(*) AS n, array_to_string(list(job_id ORDER BY job_id)[1:5], ',') AS first FROM jobs GROUP BY status")
def grouped_jobs(jobs):
    return stats.grouped(jobs, "status", "job_id", 5).select("status", "n", F.array_join("first", ",").alias("first"))


@query("people", sql="SELECT person_id, CAST(row_number() OVER (ORDER BY lower(name), name, person_id) AS INTEGER) AS place FROM people QUALIFY place <= 20")
def people_by_name_folded(people):
    """The first twenty in an order that heeds no case."""
    return stats.folded_order(people, "name", "person_id", 20).select("person_id", "place")


@query("texts", "trash", sql="WITH t AS (SELECT sha256(text) AS hash, media_id FROM texts WHERE media_id NOT IN (SELECT media_id FROM trash)) SELECT hash, count(*) AS n, min(media_id) AS first FROM t GROUP BY hash HAVING count(*) > 1")
def visible_duplicates(texts, trash):
    """Groups of copies without trashed members, while two are left."""
    groups = texts.select(F.sha2("text", 256).alias("comp"), F.col("media_id").alias("node"))
    left = dedup.visible_groups(groups, trash)
    return left.groupBy(F.col("comp").alias("hash")).agg(F.count("*").alias("n"), F.min("node").alias("first"))


@query("segments", sql="SELECT video_id, start_ms, printf('%02d:%02d', start_ms // 60000, (start_ms // 1000) % 60) AS at FROM segments WHERE person_id IN (0, 5)")
def clock_times(segments):
    return video.work_list(segments.withColumn("status", F.col("person_id")), [0, 5]).select("video_id", "start_ms", time.clock(F.col("start_ms")).alias("at"))


@query("media", sql="SELECT media_id, CASE WHEN bytes < 1024 THEN printf('%d B', bytes) WHEN bytes < 1048576 THEN printf('%.1f KB', round(bytes / CAST(1024 AS DOUBLE), 1)) ELSE printf('%.1f MB', round(bytes / CAST(1048576 AS DOUBLE), 1)) END AS size FROM media")
def byte_sizes(media):
    return media.select("media_id", text.byte_size(F.col("bytes")).alias("size"))


BOX_SQL = "b AS (SELECT tag_id, media_id, label, confidence, CAST(tag_id % 7 AS DOUBLE) / 10 AS l, CAST(tag_id % 5 AS DOUBLE) / 10 AS t, CAST(tag_id % 3 + 1 AS DOUBLE) / 10 AS w, CAST(tag_id % 4 + 1 AS DOUBLE) / 10 AS h FROM tags)"


def _boxes(tags: DataFrame) -> DataFrame:
    part = lambda n, plus, name: ((F.col("tag_id") % n + plus).cast("double") / 10).alias(name)
    return tags.select("tag_id", "media_id", "label", "confidence", part(7, 0, "left"), part(5, 0, "top"), part(3, 1, "width"), part(4, 1, "height"))


@query("tags", sql=f"WITH {BOX_SQL} SELECT a.media_id, a.tag_id AS a, b.tag_id AS b, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT a.media_id, a.tag_id AS ta, b.tag_id AS tb, greatest(0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS i, a.w * a.h + b.w * b.h AS both_ FROM b a JOIN b ON a.media_id = b.media_id AND a.tag_id < b.tag_id AND a.label = b.label) x, LATERAL (SELECT x.both_ - x.i AS u) y, LATERAL (SELECT x.media_id, x.ta AS tag_id) a, LATERAL (SELECT x.tb AS tag_id) b")
def box_overlaps(tags):
    """Boxes of one label on one item, by how far they cover each other."""
    one = _boxes(tags).select("media_id", "label", F.col("tag_id").alias("a"), F.struct("left", "top", "width", "height").alias("x"))
    other = _boxes(tags).select("media_id", "label", F.col("tag_id").alias("b"), F.struct("left", "top", "width", "height").alias("y"))
    return one.join(other, ["media_id", "label"]).where("a < b").select("media_id", "a", "b", F.round(box.iou(F.col("x"), F.col("y")), 6).alias("iou"))


@query("tags", sql=f"WITH {BOX_SQL} SELECT media_id, tag_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, tag_id) AS INTEGER) AS rank FROM b WHERE confidence >= 0.5 AND w * h >= 2e-2) WHERE rank <= 3 GROUP BY ALL")
def best_regions(tags):
    found = clusters.best_regions(_boxes(tags).withColumnRenamed("tag_id", "box_id"))
    return found.select("media_id", F.col("box_id").alias("tag_id"), "rank").distinct()


@query("tags", sql=f"WITH {BOX_SQL}, o AS (SELECT media_id, round(greatest(0, least(1, avg(confidence))), 6) AS confidence, round(min(l), 6) AS left_, round(min(t), 6) AS top_, round(max(l + w) - min(l), 6) AS width, round(max(t + h) - min(t), 6) AS height, array_to_string(list(label ORDER BY t, l, label), chr(10)) AS text FROM b GROUP BY media_id) SELECT media_id, text, confidence, left_ AS \"left\", top_ AS top, width, height FROM o")
def text_lines(tags):
    """Lines of an item in reading order, and the box around them."""
    found = video.ocr_summary(_boxes(tags).withColumnRenamed("label", "text"))
    return found.select("media_id", "text", *[F.round(c, 6).alias(c) for c in ("confidence", "left", "top", "width", "height")])


@query("texts", sql="SELECT media_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text FROM texts")
def truncated_errors(texts):
    """Messages as they are stored: of at most a thousand characters."""
    return stats.truncated(texts, "text").select("media_id", "text")


# Timeline.

GAP_SQL = "lag(ts) OVER (PARTITION BY owner ORDER BY ts, media_id)"


def _sessions_sql(test: str) -> str:
    return f"WITH g AS (SELECT *, coalesce(CAST({test} AS INTEGER), 0) AS fresh FROM (SELECT *, date_diff('microsecond', {GAP_SQL}, ts) AS gap FROM timeline)), s AS (SELECT owner, ts, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY ts, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g), b AS (SELECT owner, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY owner, session)"


@query("timeline", sql=_sessions_sql("gap > 14400000000") + ' SELECT owner, session, start, "end", n FROM b')
def sessions(timeline_):
    return timeline.session_bounds(timeline.sessions(timeline_)).select("owner", "session", "start", "end", "n")


@query("timeline", sql=_sessions_sql("gap >= 90000000000") + ' SELECT owner, session, start, "end", n FROM b')
def adaptive_sessions(timeline_):
    return timeline.session_bounds(timeline.adaptive_sessions(timeline_)).select("owner", "session", "start", "end", "n")


@query("timeline", sql=_sessions_sql("gap > 3600000000") + """, m AS (SELECT *, coalesce(CAST(date_diff('microsecond', lag("end") OVER (PARTITION BY owner ORDER BY start, session), start) > 21600000000 AS INTEGER), 0) AS fresh FROM b),
k AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY start, session ROWS UNBOUNDED PRECEDING) AS BIGINT) AS merged FROM m) SELECT owner, merged, min(start) AS start, max("end") AS "end", CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY owner, merged""")
def merged_sessions(timeline_):
    return timeline.merged_sessions(timeline.session_bounds(timeline.sessions(timeline_, gap_hours=1)), gap_hours=6)


@query("timeline", sql=_sessions_sql("gap >= 90000000000").replace("SELECT owner, ts,", "SELECT owner, ts, media_id,") + " SELECT media_id, CAST(floor((row_number() OVER (PARTITION BY owner, session ORDER BY ts, media_id) - 1) / 20) AS INTEGER) AS chunk FROM s")
def session_chunks(timeline_):
    return timeline.split_oversize(timeline.adaptive_sessions(timeline_), most=20).select("media_id", "chunk")


@query("timeline", sql=f"SELECT * FROM (SELECT owner, {GAP_SQL} AS start, ts AS \"end\", date_diff('microsecond', {GAP_SQL}, ts) AS micros FROM timeline) WHERE micros >= 43200000000")
def long_gaps(timeline_):
    return timeline.gaps(timeline_, least_hours=12)


@query("timeline", sql="SELECT media_id, n_near FROM (SELECT media_id, count(*) OVER (PARTITION BY owner ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND 7199999999 FOLLOWING) AS n_near FROM timeline) WHERE n_near >= 3")
def hotspots(timeline_):
    return timeline.hotspots(timeline_, minutes=120).select("media_id", "n_near")


@query("timeline", sql="SELECT media_id, n_recent, n_recent <= 2 AS allowed FROM (SELECT media_id, count(*) OVER (PARTITION BY owner ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_recent FROM timeline)")
def rate_limits(timeline_):
    return timeline.rate_limited(timeline_, seconds=3600, most=2).select("media_id", "n_recent", "allowed")


EVENTS_SQL = """WITH g AS (SELECT *, lag(created) OVER w AS c0, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM moments WINDOW w AS (PARTITION BY owner ORDER BY created, media_id)),
f AS (SELECT *, CASE WHEN coalesce(date_diff('hour', c0, created) >= 4 AND date_diff('microsecond', c0, created) >= 14400000000, false) OR coalesce(abs(lat - lat0) > CAST(0.005 AS DOUBLE) OR abs(lng - lng0) > CAST(0.005 AS DOUBLE), false) THEN 1 ELSE 0 END AS fresh FROM g),
e AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY created, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY owner, event) AS n_event FROM e), k AS (SELECT * FROM n WHERE n_event >= 2)"""


@query(
    "moments",
    sql=EVENTS_SQL + " SELECT owner, event, min(created) AS start, max(created) AS \"end\", count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, round(greatest(0.3, least(1.0, 0.4 * least(count(*) / 10.0, 1.0) + 0.6 * least(floor(date_diff('microsecond', min(created), max(created)) / CAST(3600000000 AS DOUBLE)) / 8.0, 1.0))), 6) AS confidence FROM k GROUP BY owner, event",
)
def events(moments):
    found = timeline.event_summary(timeline.events(moments))
    return found.select("owner", "event", "start", "end", "n", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("confidence", 6).alias("confidence"))


TRIPS_SQL = """WITH g AS (SELECT *, date_diff('microsecond', lag(created) OVER (PARTITION BY owner ORDER BY created, media_id), created) AS gap FROM moments),
k AS (SELECT *, CAST(sum(coalesce(CAST(gap >= 90000000000 AS INTEGER), 0)) OVER (PARTITION BY owner ORDER BY created, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM g),
c AS (SELECT owner, event, min(created) AS start, max(created) AS "end", count(*) AS n, avg(lat) AS lat, avg(lng) AS lng, coalesce(greatest(max(lat) - min(lat), max(lng) - min(lng)), 0) AS spread FROM k GROUP BY owner, event HAVING count(*) >= 5)"""


def _clusters(moments: DataFrame) -> DataFrame:
    """Items of each owner by runs without a gap of 25 hours."""
    return timeline.adaptive_sessions(moments, time="created").withColumnRenamed("session", "event")


@query("moments", sql=TRIPS_SQL + " SELECT owner, event, n, round(spread, 6) AS spread FROM c WHERE spread >= CAST(0.25 AS DOUBLE)")
def trips(moments):
    return timeline.trips(_clusters(moments)).select("owner", "event", "n", F.round("spread", 6).alias("spread"))


@query("moments", sql=TRIPS_SQL + f" SELECT owner, event, n FROM c WHERE {HAVERSINE_SQL.format('lat', 'CAST(40 AS DOUBLE)', 'lng', 'CAST(40 AS DOUBLE)')} / 111 >= CAST(0.5 AS DOUBLE)")
def trips_from_home(moments):
    """Half a degree and more from a home."""
    return timeline.trips(_clusters(moments), home=(40.0, 40.0)).select("owner", "event", "n")


@query(
    "moments",
    sql=TRIPS_SQL + """, t AS (SELECT * FROM c WHERE spread >= CAST(0.25 AS DOUBLE)),
    u AS (SELECT *, coalesce(CAST(date_diff('microsecond', max("end") OVER (PARTITION BY owner ORDER BY start, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) > 172800000000 AS INTEGER), 0) AS fresh FROM t),
    v AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY start, event ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip FROM u) SELECT owner, trip, min(start) AS start, max("end") AS "end", CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY owner, trip""",
)
def merged_trips(moments):
    return timeline.merged_trips(timeline.trips(_clusters(moments)))


@query(
    "moments",
    sql=EVENTS_SQL + ", s AS (SELECT owner, event, min(created) AS start FROM k GROUP BY owner, event) SELECT a.owner, a.event AS a, b.event AS b, date_diff('microsecond', a.start, b.start) AS micros FROM s a JOIN s b ON a.owner = b.owner AND (a.start < b.start OR (a.start = b.start AND a.event < b.event)) AND date_diff('microsecond', a.start, b.start) < 90000000000",
)
def events_close_in_time(moments):
    """Of one owner: what others did at the time makes no pair."""
    starts = timeline.events(moments).groupBy("owner", "event").agg(F.min("created").alias("start"))
    return timeline.band_pairs(starts, by=["owner"])


@query("media", sql=f"SELECT media_id, CASE WHEN month(created) IN (3, 4, 5) THEN 'Spring' WHEN month(created) IN (6, 7, 8) THEN 'Summer' WHEN month(created) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS season, CASE WHEN date_diff('day', CAST(created AS DATE), CAST({NOW_SQL} AS DATE)) = 0 THEN 'Today' WHEN date_diff('day', CAST(created AS DATE), CAST({NOW_SQL} AS DATE)) = 1 THEN 'Yesterday' WHEN year(created) = 2001 THEN strftime(created, '%B %-d') ELSE strftime(created, '%B %-d, %Y') END AS label FROM media")
def timeline_labels(media):
    return media.select("media_id", time.season(F.col("created")).alias("season"), time.timeline_label(F.col("created"), now()).alias("label"))


@query("timeline", sql="SELECT media_id, CASE WHEN hour(ts) >= 5 AND hour(ts) < 12 THEN 'Morning' WHEN hour(ts) >= 12 AND hour(ts) < 17 THEN 'Afternoon' WHEN hour(ts) >= 17 AND hour(ts) < 21 THEN 'Evening' ELSE 'Late Night' END AS part FROM timeline")
def day_parts(timeline_):
    return timeline_.select("media_id", time.day_part(F.col("ts")).alias("part"))


# Joins.


@query(
    "moments",
    sql=f"SELECT media_id, previous, round({HAVERSINE_SQL.format('lat0', 'lat', 'lng0', 'lng')}, 4) AS km FROM (SELECT media_id, lat, lng, lag(media_id) OVER w AS previous, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM moments WHERE lat IS NOT NULL AND lng IS NOT NULL WINDOW w AS (PARTITION BY owner ORDER BY created, media_id)) WHERE previous IS NOT NULL",
)
def distances(moments):
    """From every located item to its owner's one before."""
    return timeline.moves(moments).select("media_id", "previous", F.round("km", 4).alias("km"))


@query("media", sql=f"SELECT media_id, round({HAVERSINE_SQL.format('CAST(10 AS DOUBLE)', 'lat', 'CAST(20 AS DOUBLE)', 'lng')}, 4) AS km FROM media WHERE lat IS NOT NULL AND lng IS NOT NULL")
def distances_to_position(media):
    """From every located item to one position."""
    placed = media.where("lat is not null and lng is not null")
    return placed.select("media_id", F.round(geo.haversine_km(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lng")), 4).alias("km"))


@query("faces", sql="WITH f AS (SELECT DISTINCT media_id, person_id FROM faces) SELECT a.person_id AS person_id, b.person_id AS other, count(*) AS n FROM f a JOIN f b ON a.media_id = b.media_id AND a.person_id < b.person_id GROUP BY 1, 2")
def people_together(faces):
    e = graph.together(faces)
    return e.select(F.col("source").cast("long").alias("person_id"), F.col("target").cast("long").alias("other"), F.col("weight").cast("long").alias("n"))


@query("media", "states", sql="SELECT m.media_id FROM media m LEFT JOIN states s USING (media_id) WHERE s.is_good IS NULL OR s.is_good <> 1")
def needs_analysis(media, states):
    return stats.outdated(media, states.select("media_id", F.col("is_good").cast("string").alias("version")), "1")


@query("media", "tags", sql="SELECT media_id, CASE WHEN t THEN 'orphaned' ELSE 'missing' END AS state FROM (SELECT media_id, true AS t FROM media WHERE media_id NOT IN (SELECT media_id FROM tags) UNION ALL SELECT DISTINCT media_id, false FROM tags WHERE media_id NOT IN (SELECT media_id FROM media))")
def reconciled(media, tags):
    return tables.reconcile(media, tags)


@query("media", sql="SELECT media_id, CASE WHEN i IS NULL THEN 'new' WHEN s IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT media_id, CASE WHEN media_id % 3 = 0 THEN created + INTERVAL 1 HOUR ELSE created END AS s FROM media WHERE media_id % 10 <> 1) FULL JOIN (SELECT media_id, created AS i FROM media WHERE media_id % 10 <> 2) USING (media_id) WHERE i IS NULL OR s IS NULL OR s > i")
def scan_changes(media):
    source = media.where("media_id % 10 <> 1").select("media_id", F.when(F.col("media_id") % 3 == 0, F.col("created") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("created")).alias("modified"))
    return tables.scan_diff(source, media.where("media_id % 10 <> 2").select("media_id", F.col("created").alias("modified")))


@query("media", sql="SELECT media_id, CASE WHEN media_id % 2 = 0 THEN coalesce(quality, 0) + 1 ELSE quality END AS quality FROM media")
def upserted(media):
    stored = media.select("media_id", "quality")
    return tables.upsert(stored, stored.where("media_id % 2 = 0").withColumn("quality", F.coalesce("quality", F.lit(0.0)) + 1), ["media_id"])


@query("media", sql="SELECT media_id, quality FROM media WHERE media_id % 2 = 0 UNION ALL SELECT media_id, CAST(0 AS DOUBLE) FROM media WHERE media_id % 2 = 1")
def insert_ignored(media):
    stored = media.where("media_id % 2 = 0").select("media_id", "quality")
    return tables.insert_ignore(stored, media.select("media_id", F.lit(0.0).alias("quality")), ["media_id"], [F.col("quality")])


@query("tags", "trash", sql="SELECT media_id, label, confidence FROM tags WHERE media_id NOT IN (SELECT media_id FROM trash)")
def cascaded(tags, trash):
    return tables.delete_cascade({"tags": tags}, trash)["tags"].select("media_id", "label", "confidence")


# Duplicates.


@query("texts", sql="SELECT sha256(text) AS hash, count(*) AS n, min(media_id) AS first FROM texts GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(texts):
    return dedup.exact_groups(texts.select("media_id", F.sha2("text", 256).alias("content_hash"))).select("hash", "n", "first")


HASH_SQL = "h AS (SELECT media_id, CAST(media_id * 2654435761 % 4294967296 AS BIGINT) & 4278255360 AS hi, CAST(media_id * 40503 % 4294967296 AS BIGINT) & 16711935 AS lo FROM vectors)"


def _hashes(vectors: DataFrame) -> DataFrame:
    return vectors.selectExpr("media_id", "(media_id * 2654435761 % 4294967296) & 4278255360 AS hi", "(media_id * 40503 % 4294967296) & 16711935 AS lo")


@query("vectors", sql=f"WITH {HASH_SQL} SELECT a.media_id AS a, b.media_id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS bits FROM h a JOIN h b ON a.media_id < b.media_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 5")
def near_duplicate_pairs(vectors):
    return dedup.hamming_pairs(_hashes(vectors), within=5)


@query(
    "vectors",
    sql=f"WITH RECURSIVE {HASH_SQL}, e AS (SELECT a.media_id AS a, b.media_id AS b FROM h a JOIN h b ON a.media_id <> b.media_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3), r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS comp FROM r GROUP BY node",
)
def near_duplicate_groups(vectors):
    return dedup.near_groups(_hashes(vectors), within=3)


@query("texts", sql="WITH g AS (SELECT sha256(text) AS h, media_id, length(text) % 10 / CAST(10 AS DOUBLE) AS q, source FROM texts) SELECT h AS comp, max_by(media_id, [CAST(media_id % 7 AS DOUBLE), -CAST(media_id AS DOUBLE)]) AS best FROM g GROUP BY h HAVING count(*) > 1")
def best_of_duplicates(texts):
    hashed = texts.select("media_id", F.sha2("text", 256).alias("comp"))
    several = hashed.groupBy("comp").count().where("count > 1").select("comp")
    groups = hashed.join(several, "comp", "left_semi").select("comp", F.col("media_id").alias("node"))
    return dedup.keep_best(texts.select("media_id", (F.col("media_id") % 7).cast("double").alias("quality")), groups)


# Graph.


def _graph(media, faces, people, tags):
    return graph.build(media, faces, people, tags)


@query(
    "media", "faces", "people", "tags",
    sql="""WITH p AS (SELECT media_id, printf('%.2f', round(lat, 2)) || ',' || printf('%.2f', round(lng, 2)) AS place FROM media WHERE lat IS NOT NULL AND lng IS NOT NULL), f AS (SELECT DISTINCT media_id, person_id FROM faces)
    SELECT 'entity' AS what, 'media' AS name, count(DISTINCT media_id) AS n FROM media UNION ALL SELECT 'entity', 'person', count(*) FROM people UNION ALL SELECT 'entity', 'place', count(DISTINCT place) FROM p UNION ALL SELECT 'entity', 'label', count(DISTINCT label) FROM tags UNION ALL SELECT 'entity', 'album', count(DISTINCT album) FROM media
    UNION ALL SELECT 'edge', 'media_contains_person', count(*) FROM f UNION ALL SELECT 'edge', 'media_taken_at_place', count(*) FROM p UNION ALL SELECT 'edge', 'media_has_label', count(*) FROM (SELECT DISTINCT media_id, label FROM tags) UNION ALL SELECT 'edge', 'media_in_album', count(*) FROM media
    UNION ALL SELECT 'edge', 'person_visited_place', count(*) FROM (SELECT DISTINCT person_id, place FROM faces JOIN p USING (media_id)) UNION ALL SELECT 'edge', 'people_co_occurs', count(*) FROM (SELECT DISTINCT a.person_id, b.person_id FROM f a JOIN f b ON a.media_id = b.media_id AND a.person_id < b.person_id)""",
)
def graph_stats(media, faces, people, tags):
    return graph.stats(*_graph(media, faces, people, tags))


@query("media", "faces", "people", "tags", sql="SELECT CAST(person_id AS VARCHAR) AS target, max(confidence) AS confidence, CAST(count(*) AS DOUBLE) AS weight FROM faces WHERE media_id = 3 GROUP BY person_id")
def graph_outgoing(media, faces, people, tags):
    return graph.outgoing(_graph(media, faces, people, tags)[1], "3", relations=["media_contains_person"]).select("target", "confidence", "weight")


@query(
    "media", "faces", "people", "tags",
    sql="WITH w AS (SELECT media_id, person_id, count(*) AS w FROM faces GROUP BY 1, 2), t AS (SELECT media_id, label, count(*) AS w FROM tags GROUP BY 1, 2), v AS (SELECT w.media_id, t.label, w.w * t.w AS w FROM w JOIN t USING (media_id) WHERE w.person_id = 5) SELECT label AS external_id, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS paths FROM v GROUP BY label",
)
def graph_two_hop(media, faces, people, tags):
    nodes, links = _graph(media, faces, people, tags)
    turned = links.where("relation = 'media_contains_person'").select(F.lit("person_in_media").alias("relation"), F.col("target").alias("source"), F.col("source").alias("target"), "confidence", "weight")
    both = turned.unionByName(links.where("relation = 'media_has_label'"))
    return graph.two_hop(both, nodes, "5", "person_in_media", "media_has_label", "label").select("external_id", "weight", "paths")


@query("media", "faces", "people", "tags", sql="WITH f AS (SELECT DISTINCT media_id, person_id FROM faces), o AS (SELECT b.person_id AS other, count(*) AS n FROM f a JOIN f b ON a.media_id = b.media_id AND a.person_id = 5 AND b.person_id <> 5 GROUP BY 1) SELECT CAST(other AS VARCHAR) AS external_id, p.name, CAST(n AS DOUBLE) AS weight FROM o JOIN people p ON p.person_id = o.other")
def graph_co_occurring(media, faces, people, tags):
    nodes, links = _graph(media, faces, people, tags)
    return graph.co_occurring(links, nodes, "5").select("external_id", "name", "weight")


@query("faces", sql="SELECT CAST(person_id AS VARCHAR) AS target, max(confidence) AS confidence, CAST(2 * count(*) AS DOUBLE) AS weight FROM faces GROUP BY person_id")
def edges_upserted(faces):
    rows = graph.edges(faces.withColumn("all", F.lit("all")), "seen", F.col("all"), F.col("person_id"), confidence=F.col("confidence"))
    dated = rows.withColumn("evidence", F.lit("face")).withColumn("updated", F.lit(NOW).cast("timestamp_ntz"))
    return tables.upsert_edges(dated, dated).select("target", "confidence", "weight")


# Video.


@query("segments", sql="SELECT video_id, CAST(s AS BIGINT) AS start_ms, least(s + step, d) AS end_ms FROM (SELECT video_id, d, step, unnest(range(0, d, step)) AS s FROM (SELECT video_id, max(end_ms) AS d, CAST(CASE WHEN max(end_ms) <= 30000 THEN 10000 WHEN max(end_ms) <= 120000 THEN 15000 WHEN max(end_ms) <= 300000 THEN 30000 ELSE 60000 END AS BIGINT) AS step FROM segments GROUP BY video_id HAVING max(end_ms) > 0))")
def fixed_segments(segments):
    return video.fixed_segments(segments.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")))


DURATION_SQL = "v AS (SELECT video_id, max(end_ms) AS d, greatest(1, least(12, max(end_ms) // 1000)) AS n FROM segments GROUP BY video_id HAVING max(end_ms) > 0)"
UNNEST_SQL = "SELECT video_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS frame, CAST(unnest(t) AS BIGINT) AS ts_ms FROM (SELECT video_id, {} AS t FROM {})"


def _durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


@query("segments", sql=f"WITH {DURATION_SQL} " + UNNEST_SQL.format("list_transform(range(0, n), lambda i: i * (d // n) + (d // n) // 2)", "v"))
def sampled_frames(segments):
    return video.sample_times(_durations(segments))


@query(
    "segments",
    sql=f"WITH {DURATION_SQL}, c AS (SELECT *, d // 4 AS q, greatest(1, CAST(floor(n * 3e-1 + 0.5) AS BIGINT)) AS early, greatest(1, CAST(floor(n * 5e-1 + 0.5) AS BIGINT)) AS middle FROM v), e AS (SELECT *, greatest(1, n - early - middle) AS late FROM c) "
    + UNNEST_SQL.format("list_sort(list_concat(list_concat(list_transform(range(0, early), lambda i: q * i // early + 500), list_transform(range(0, middle), lambda i: q + q * 2 * i // middle + 500)), list_transform(range(0, late), lambda i: q * 3 + q * i // late + 500)))[1:n]", "e"),
)
def adaptive_frames(segments):
    return video.adaptive_times(_durations(segments))


def _key_moments_sql(rounds: int = 4) -> str:
    """Rounds that fill up, each a CTE: one beyond the last changes nothing."""
    parts = [DURATION_SQL, "a0 AS (SELECT *, [2500, CAST(floor(d * 25e-2) AS BIGINT), CAST(floor(d * 5e-1) AS BIGINT), CAST(floor(d * 75e-2) AS BIGINT), greatest(0, d - 5000)] AS a FROM v)"]
    for k in range(rounds):
        parts.append(f"a{k + 1} AS (SELECT video_id, d, n, CASE WHEN len(a) < n AND (len(a) = 5 OR len(a) < d // 1000) THEN list_sort(list_distinct(list_concat(a, list_transform(range(1, len(a) + 2), lambda i: i * (d // (len(a) + 1)))))) ELSE a END AS a FROM a{k})")
    return "WITH " + ", ".join(parts) + " " + UNNEST_SQL.format("a[1:n]", f"a{rounds}")


@query("segments", sql=_key_moments_sql())
def key_moments(segments):
    return video.key_moments(_durations(segments))


def _frames(segments: DataFrame) -> DataFrame:
    return segments.select("video_id", (F.col("start_ms") + 1500).alias("ts_ms"))


FRAMES_SQL = "WITH f AS (SELECT DISTINCT video_id, start_ms + 1500 AS ts_ms FROM segments), s AS (SELECT DISTINCT video_id, start_ms, end_ms FROM segments)"


@query("segments", sql=FRAMES_SQL + " SELECT video_id, ts_ms, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY start_ms, end_ms) AS pos FROM f JOIN s USING (video_id) WHERE ts_ms >= start_ms AND ts_ms < end_ms) WHERE pos = 1")
def frames_in_segments(segments):
    return video.in_segments(_frames(segments), segments.select("video_id", "start_ms", "end_ms"))


@query("segments", sql=FRAMES_SQL + " SELECT video_id, ts_ms, start_ms, end_ms, off FROM (SELECT *, abs(start_ms - ts_ms) AS off, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY abs(start_ms - ts_ms), start_ms, end_ms) AS pos FROM f JOIN s USING (video_id)) WHERE pos = 1")
def frames_to_nearest_segment(segments):
    return video.nearest_segment(_frames(segments), segments.select("video_id", "start_ms", "end_ms"))


@query("segments", sql="WITH c AS (SELECT DISTINCT video_id, start_ms - 2000 AS start_ms, start_ms + 3000 AS end_ms FROM segments) SELECT c.video_id, c.start_ms, c.end_ms, array_to_string(list_sort(list_distinct(list(s.label))), ',') AS labels FROM c JOIN segments s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms GROUP BY 1, 2, 3")
def chapters(segments):
    scenes = segments.select("video_id", (F.col("start_ms") - 2000).alias("start_ms"), (F.col("start_ms") + 3000).alias("end_ms")).distinct()
    rows = segments.select("video_id", "start_ms", "end_ms", F.array(F.col("person_id").cast("string")).alias("people"), F.array("label").alias("labels"))
    return video.chapters(scenes, rows).select("video_id", "start_ms", "end_ms", F.array_join("labels", ",").alias("labels"))


@query("segments", sql="SELECT video_id, start_ms, end_ms, label, round(CAST(0.1 AS DOUBLE) + CASE WHEN contains(lower(label), 'f') THEN 0.3 ELSE 0 END + CASE WHEN person_id = 4 THEN 0.5 ELSE 0 END, 6) AS score FROM segments WHERE start_ms <= 8000 AND end_ms >= 4000")
def video_search(segments):
    rows = segments.withColumn("people", F.array(F.col("person_id").cast("string"))).withColumn("labels", F.array("label")).withColumn("ocr_text", F.lit(""))
    found = video.searched(rows, label="f", person="4", between=(4000, 8000))
    return found.select("video_id", "start_ms", "end_ms", "label", F.round("score", 6).alias("score"))


RICH_SQL = "seg AS (SELECT *, person_id % 2 = 0 AS peopled, start_ms % 8000 = 0 AS texted FROM segments), sc AS (SELECT DISTINCT video_id, start_ms - 2000 AS start_ms, start_ms + 3000 AS end_ms, CAST(start_ms % 3 AS DOUBLE) / 2 AS sure FROM segments), du AS (SELECT video_id, max(end_ms) / CAST(count(*) AS DOUBLE) AS mean, max(end_ms) AS duration_ms FROM segments GROUP BY video_id)"
HIGHLIGHTS_SQL = RICH_SQL + """, met AS (SELECT c.video_id, c.start_ms, c.end_ms, c.sure, count(*) FILTER (WHERE peopled) AS p, list_sort(list_distinct(list(label))) AS labels, bool_or(texted) AS texted FROM sc c JOIN seg s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms GROUP BY ALL),
    hl AS (SELECT * FROM (SELECT m.*, greatest(0, least(1, least(3e-1, p * 1e-1) + least(2e-1, len(labels) * 4e-2) + CASE WHEN texted THEN 1e-1 ELSE 0e0 END + CASE WHEN m.end_ms - m.start_ms < mean * 7e-1 THEN 1e-1 ELSE 0e0 END + sure * 1e-1)) AS score FROM met m JOIN du USING (video_id)) WHERE score >= 4e-1)"""


def _rich(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenes, segments and videos with all that their operators read."""
    rows = segments.withColumns({
        "people": F.when(F.col("person_id") % 2 == 0, F.array(F.col("person_id").cast("string"))).otherwise(F.array().cast("array<string>")), "labels": F.array("label"),
        "ocr_text": F.when(F.col("start_ms") % 8000 == 0, "seen"),
    }).drop("confidence", "score", "label", "person_id")
    found = segments.select("video_id", (F.col("start_ms") - 2000).alias("start_ms"), (F.col("start_ms") + 3000).alias("end_ms"), ((F.col("start_ms") % 3).cast("double") / 2).alias("confidence")).distinct()
    return found, rows, _durations(segments)


@query("segments", sql=f"WITH {HIGHLIGHTS_SQL} SELECT video_id, start_ms, end_ms, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN p > 0 THEN p || ' people detected' END, 'Objects: ' || array_to_string(labels[1:3], ', '), CASE WHEN texted THEN 'Text detected on screen' END], lambda x: x IS NOT NULL), '; ') AS reason FROM hl")
def highlights(segments):
    found = video.highlights(*_rich(segments))
    return found.select("video_id", "start_ms", "end_ms", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reason"))


@query("segments", sql=f"WITH {HIGHLIGHTS_SQL} SELECT d.video_id, d.duration_ms, (SELECT count(*) FROM sc WHERE sc.video_id = d.video_id) AS n_scenes, (SELECT count(DISTINCT person_id) FROM seg WHERE peopled AND seg.video_id = d.video_id) AS n_people, (SELECT count(DISTINCT label) FROM seg WHERE seg.video_id = d.video_id) AS n_labels, (SELECT CAST(bool_or(texted) AS BIGINT) FROM seg WHERE seg.video_id = d.video_id) AS n_texts, (SELECT count(*) FROM hl WHERE hl.video_id = d.video_id) AS n_highlights FROM du d")
def video_summaries(segments):
    found, rows, videos = _rich(segments)
    return video.summaries(found, rows, video.highlights(found, rows, videos), videos)


@query("segments", sql="WITH f AS (SELECT DISTINCT video_id, start_ms AS ts_ms FROM segments), g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms) AS gap FROM f) SELECT video_id, round(CASE WHEN coalesce(avg(gap), 0) = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - stddev_pop(gap) / avg(gap) / 2)) END, 6) AS evenness FROM g GROUP BY video_id")
def frame_evenness(segments):
    return video.evenness(segments.select("video_id", F.col("start_ms").alias("ts_ms")).distinct()).select("video_id", F.round("evenness", 6).alias("evenness"))


@query("segments", sql="""WITH f AS (SELECT video_id, end_ms AS ts_ms, confidence * 97e-2 AS blur, CASE WHEN start_ms % 3 = 0 THEN NULL ELSE least(1, score / CAST(60000 AS DOUBLE)) END AS quality FROM segments), g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms) AS gap FROM f),
    q AS (SELECT video_id, coalesce(avg(blur), 0.5) AS blur, coalesce(avg(quality), 0.5) AS quality, count(*) AS n, CASE WHEN coalesce(avg(gap), 0) = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - stddev_pop(gap) / avg(gap) / 2)) END AS even FROM g GROUP BY video_id)
    SELECT video_id, round(greatest(0, least(1, 0.4 * greatest(0, least(1, 1 - blur)) + 0.4 * quality + 0.2 * even)), 6) AS score, array_to_string(list_filter([CASE WHEN blur > 0.7 THEN 'blurry' END, CASE WHEN quality < 0.3 THEN 'low_quality' END, CASE WHEN n < 3 THEN 'few_frames' END, CASE WHEN even < 0.3 THEN 'uneven' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""")
def video_quality(segments):
    frames = segments.select("video_id", F.col("end_ms").alias("ts_ms"), (F.col("confidence") * 0.97).alias("blur"), F.when(F.col("start_ms") % 3 != 0, F.least(F.lit(1.0), F.col("score") / 60000.0)).alias("quality"))
    return video.quality(frames).select("video_id", F.round("score", 6).alias("score"), F.array_join("issues", ",").alias("issues"))


@query("segments", sql="SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY end_ms, start_ms) AS INTEGER) AS rank, end_ms * 10000 + start_ms AS ts_ms FROM segments WHERE label = 'NO'")
def representative_frames(segments):
    return video.representative(segments.select("video_id", (F.col("end_ms") * 10000 + F.col("start_ms")).alias("ts_ms"), (F.col("label") == "NO").alias("representative")))


@query("vectors", sql="""WITH f AS (SELECT media_id // 10 AS video_id, media_id % 10 * 1500 AS ts, vector::DOUBLE[] AS vector, row_number() OVER w AS pos, lag(vector::DOUBLE[]) OVER w AS before FROM vectors WINDOW w AS (PARTITION BY media_id // 10 ORDER BY media_id)),
s AS (SELECT video_id, CASE WHEN pos = 1 THEN 0 ELSE ts END AS start_ms FROM f WHERE pos = 1 OR greatest(0, least(1, 1 - list_cosine_similarity(before, vector))) > 9e-1),
e AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms), 15000) AS end_ms FROM s), k AS (SELECT * FROM e WHERE end_ms - start_ms >= 1000),
l AS (SELECT *, CAST(end_ms - start_ms >= 3000 OR row_number() OVER (PARTITION BY video_id ORDER BY start_ms) = 1 AS INTEGER) AS long_ FROM k), g AS (SELECT *, CAST(sum(long_) OVER (PARTITION BY video_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene FROM l)
SELECT video_id, scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY video_id, scene""")
def scenes(vectors):
    """Ten frames to a video, cut where neighbours differ."""
    frames = vectors.select(F.floor(F.col("media_id") / 10).alias("video_id"), (F.col("media_id") % 10 * 1500).alias("ts_ms"), "vector", F.lit(15_000).cast("long").alias("duration_ms"))
    return video.merged_scenes(video.scenes(frames, threshold=0.9))


# Albums, memories, clusters.


MEMORIES_SQL = EVENTS_SQL + """, m AS (SELECT owner, event, count(*) AS n, min(created) AS start, max(created) AS finish, count(lat) AS located, greatest(max(lat) - min(lat), max(lng) - min(lng)) AS spread, avg(CAST(has_people AS DOUBLE)) AS people, date_diff('microsecond', min(created), max(created)) AS micros FROM k GROUP BY owner, event),
    b AS (SELECT owner, event, avg(quality) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY owner, event ORDER BY quality DESC) AS pos, count(*) OVER (PARTITION BY owner, event) AS known FROM k WHERE quality IS NOT NULL) WHERE pos <= greatest(1, ceil(known * CAST(0.7 AS DOUBLE))) GROUP BY owner, event),
    vk AS (SELECT k.owner, k.event, k.media_id, v.vector FROM k JOIN vectors v USING (media_id)),
    sm AS (SELECT v.owner, v.event, avg(list_cosine_similarity(v.vector::DOUBLE[], q.vector::DOUBLE[])) AS semantic FROM vk v JOIN vk q ON v.owner = q.owner AND v.event = q.event AND v.media_id < q.media_id GROUP BY 1, 2),
    p AS (SELECT m.*, n / greatest(floor(micros / 6e7) / 6e1, 1e0) AS density, floor(micros / 864e8) AS days, coalesce(greatest(0, least(1, semantic)), 0.5) AS semantic, coalesce(b.quality, 0.5) AS quality FROM m LEFT JOIN b USING (owner, event) LEFT JOIN sm USING (owner, event)),
    mem AS (SELECT * FROM (SELECT *, 25e-2 * greatest(0, least(1, 6e-1 * (CASE WHEN density >= 2 AND density <= 20 THEN 1e0 WHEN density < 2 THEN density / 2 ELSE 1 - (density - 20) / 8e1 END) + 4e-1 * (CASE WHEN days = 0 THEN 1e0 WHEN days BETWEEN 2 AND 7 THEN 9e-1 WHEN days > 7 THEN 7e-1 ELSE 5e-1 END)))
      + 2e-1 * (CASE WHEN located = 0 THEN 3e-1 WHEN located / CAST(n AS DOUBLE) > 5e-1 THEN (CASE WHEN spread < 1e-2 THEN 1e0 WHEN spread < 5e-2 THEN 9e-1 WHEN spread < 1e-1 THEN 8e-1 ELSE 7e-1 END) ELSE located / CAST(n AS DOUBLE) END)
      + 2e-1 * (CASE WHEN people >= 5e-1 THEN 1e0 WHEN people >= 2e-1 THEN 8e-1 WHEN people > 0 THEN 6e-1 ELSE 3e-1 END) + 2e-1 * semantic + 15e-2 * quality AS score FROM p) WHERE score >= 3e-1)"""


@query("moments", "vectors", sql=MEMORIES_SQL + " SELECT owner, event, n, round(score, 5) AS score FROM mem")
def memories(moments, vectors):
    found = albums.memory_scores(timeline.events(moments), ["owner", "event"], vectors=vectors)
    return found.select("owner", "event", "n", F.round("score", 5).alias("score"))


ALBUM_NOW, ALBUM_NOW_SQL = datetime(2025, 3, 1), "TIMESTAMP '2025-03-01 00:00:00'"


def _memory_tables(moments: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories of events, their items in order and their people."""
    rows = settle(timeline.events(moments).withColumn("memory_id", F.col("owner") * 1000 + F.col("event")))
    found = settle(albums.memory_scores(rows, ["memory_id"], vectors=vectors))
    place = F.when(F.col("located") > 0, "here")
    scored = found.select("memory_id", "n", "start", "end", "score", F.lit(None).cast("array<string>").alias("people"), place.alias("place"))
    scored = scored.withColumn("theme", albums.theme(scored))
    w = Window.partitionBy("memory_id").orderBy("created", "media_id")
    return scored, rows.select("memory_id", "media_id", F.row_number().over(w).alias("position")), rows.select("memory_id", "person_id").distinct()


ALBUMS_SQL = MEMORIES_SQL + f""", mm AS (SELECT owner * 1000 + event AS memory_id, *, CASE WHEN CAST(start AS DATE) <> CAST(finish AS DATE) AND located > 0 THEN 'trip' ELSE 'other' END AS theme FROM mem),
    it AS (SELECT mm.memory_id, mm.start, mm.score, mm.theme, k.media_id, k.person_id, row_number() OVER (PARTITION BY mm.memory_id ORDER BY k.created, k.media_id) AS position FROM mm JOIN k ON k.owner = mm.owner AND k.event = mm.event),
    named AS (SELECT 'best_of_year' AS category, CAST(year(start) AS VARCHAR) AS name, it.*, -score AS o FROM it WHERE year(start) <> year({ALBUM_NOW_SQL}) UNION ALL SELECT 'month', strftime(start, '%Y-%m'), it.*, -score FROM it WHERE strftime(start, '%Y-%m') <> strftime({ALBUM_NOW_SQL}, '%Y-%m')
      UNION ALL SELECT 'season', (CASE WHEN month(start) IN (3, 4, 5) THEN 'Spring' WHEN month(start) IN (6, 7, 8) THEN 'Summer' WHEN month(start) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END) || ' ' || year(start), it.*, 0 FROM it),
    al AS (SELECT category, name, least(100, count(*)) AS n, max(score) AS score, min(start) AS start, first(media_id ORDER BY round(o, 9), memory_id, position) AS cover FROM named GROUP BY category, name HAVING count(*) >= CASE category WHEN 'best_of_year' THEN 10 WHEN 'month' THEN 5 ELSE 15 END
      UNION ALL SELECT 'trip', CAST(memory_id AS VARCHAR), count(*), max(score), min(start), first(media_id ORDER BY position) FROM it WHERE theme = 'trip' GROUP BY memory_id HAVING count(*) >= 5
      UNION ALL SELECT 'person', CAST(person_id AS VARCHAR), count(*), 0.5, min(start), first(media_id ORDER BY memory_id, position) FROM (SELECT pe.person_id, it.media_id, it.memory_id, it.position, it.start FROM (SELECT DISTINCT memory_id, person_id FROM it) pe JOIN it USING (memory_id)) GROUP BY person_id HAVING count(*) >= 10)"""


@query("moments", "vectors", sql=ALBUMS_SQL + " SELECT category, name, n, round(score, 6) AS score, start, cover FROM al")
def automatic_albums(moments, vectors):
    scored, members, people = _memory_tables(moments, vectors)
    scored = scored.withColumn("score", F.round("score", 9))
    found = albums.albums(scored, members, people, F.lit(ALBUM_NOW).cast("timestamp_ntz"))
    return found.select("category", "name", "n", F.round("score", 6).alias("score"), "start", "cover")


@query(
    "moments",
    sql=EVENTS_SQL + """, m AS (SELECT owner, event, count(*) AS n, min(created) AS s, max(created) AS f, count(lat) AS located FROM k GROUP BY owner, event),
    t AS (SELECT *, CASE WHEN CAST(s AS DATE) <> CAST(f AS DATE) AND located > 0 THEN 'trip' WHEN located > 0 AND n >= 5 THEN 'event' ELSE 'everyday' END AS theme FROM m)
    SELECT owner, event, theme, concat_ws(' ', CASE theme WHEN 'trip' THEN 'Trip' WHEN 'event' THEN 'Event' END, CASE WHEN located > 0 THEN 'in Town' END, CASE WHEN CAST(s AS DATE) = CAST(f AS DATE) THEN strftime(s, '%A, %B %-d') WHEN month(s) = month(f) THEN strftime(s, '%B %-d') || '–' || strftime(f, '%-d') ELSE strftime(s, '%B %-d') || ' – ' || strftime(f, '%B %-d') END, '2024') AS title, CASE WHEN n > 10 THEN n || ' photos' END AS subtitle FROM t""",
)
def memory_titles(moments):
    by = timeline.events(moments).groupBy("owner", "event").agg(F.count("*").alias("n"), F.min("created").alias("start"), F.max("created").alias("end"), F.when(F.count("lat") > 0, "Town").alias("place"))
    found = albums.titled(by.withColumn("people", F.lit(None).cast("array<string>")), F.lit(ALBUM_NOW).cast("timestamp_ntz"))
    return found.select("owner", "event", "theme", "title", "subtitle")


COVER_SQL = "c AS (SELECT media_id, album, greatest(0, least(1, 0.4 * coalesce(quality, 0.5) + 0.3 * coalesce(blur, 0.5) + 0.15)) - CASE WHEN coalesce(quality > 0.7 AND blur > 0.7, false) THEN 0 ELSE 0.3 END + CASE WHEN person_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN (width / height >= 1.3 AND width / height <= 1.8) OR (width / height >= 0.55 AND width / height <= 0.77) OR (width / height >= 0.9 AND width / height <= 1.1) THEN 0.1 ELSE 0 END AS score FROM media)"


def _cover_scores(media: DataFrame) -> DataFrame:
    return media.withColumn("score", clusters.cover_score(F.col("quality"), F.col("blur"), F.col("person_id") % 2 == 0, F.col("width"), F.col("height")))


@query("media", sql=f"WITH {COVER_SQL} SELECT media_id, round(score, 6) AS score FROM c")
def cover_scores(media):
    return _cover_scores(media).select("media_id", F.round("score", 6).alias("score"))


@query("media", sql=f"WITH {COVER_SQL} SELECT album, media_id AS cover FROM (SELECT *, row_number() OVER (PARTITION BY album ORDER BY round(score, 9) DESC, media_id) AS pos FROM c) WHERE pos = 1")
def album_covers(media):
    return clusters.covers(_cover_scores(media).withColumn("score", F.round("score", 9)), ["album"])


@query("vectors", sql="WITH p AS (SELECT region, i, avg(CAST(vector[i] AS DOUBLE)) AS x FROM (SELECT region, vector, unnest(range(1, len(vector) + 1)) AS i FROM vectors) GROUP BY region, i) SELECT region, round(sum(x), 6) AS total, round(max(x), 6) AS most FROM p GROUP BY region")
def mean_vectors(vectors):
    found = clusters.mean_vectors(vectors, ["region"])
    return found.select("region", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("vector"), 6).alias("most"))


@query("vectors", sql=f"SELECT v.region, round(1 - avg({COSINE}), 6) AS diversity FROM vectors v JOIN vectors q ON v.region = q.region AND v.media_id < q.media_id GROUP BY v.region")
def cluster_diversity(vectors):
    """From the length of the mean unit vector, where the twin goes through all pairs."""
    return clusters.coherence(vectors, ["region"]).select("region", F.round("diversity", 6).alias("diversity"))


ASSIGNED_SQL = """WITH RECURSIVE f AS (SELECT media_id AS face_id, region AS person_id, media_id % 2 = 0 AS known, vector::DOUBLE[] AS v FROM vectors),
s AS (SELECT a.face_id, b.face_id AS other, b.known, round(list_cosine_similarity(a.v, b.v), 12) AS similarity FROM f a JOIN f b ON NOT a.known AND (b.known OR b.face_id < a.face_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY similarity DESC, known DESC, other) AS pos FROM s),
u AS (SELECT f.face_id, CASE WHEN r.similarity >= CAST(0.45 AS DOUBLE) THEN r.other END AS up, CASE WHEN r.similarity >= CAST(0.45 AS DOUBLE) THEN r.similarity END AS similarity FROM f LEFT JOIN r ON r.face_id = f.face_id AND pos = 1 WHERE NOT f.known),
w AS (SELECT face_id, face_id AS at, up FROM u UNION ALL SELECT w.face_id, w.up, u.up FROM w LEFT JOIN u ON u.face_id = w.up WHERE w.up IS NOT NULL)
SELECT w.face_id, CASE WHEN f.known THEN f.person_id END AS person_id, CASE WHEN NOT f.known THEN w.at END AS founder, round(u.similarity, 6) AS similarity FROM w JOIN f ON f.face_id = w.at JOIN u ON u.face_id = w.face_id WHERE w.up IS NULL"""


@query("vectors", sql=ASSIGNED_SQL)
def faces_assigned(vectors):
    """Every second face in the order of ids, each compared with all faces that have a person by then; at 0.45, as the fixture's vectors are nearly random."""
    faces = vectors.select(F.col("media_id").alias("face_id"), F.col("region").alias("person_id"), "vector")
    found = faceindex.assigned(faces.where("face_id % 2 = 1").drop("person_id"), faces.where("face_id % 2 = 0"), least=0.45)
    return found.select("face_id", "person_id", "founder", F.round("similarity", 6).alias("similarity"))


LEADERS_SQL = """WITH RECURSIVE f AS (SELECT region AS block, media_id AS face_id, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY region ORDER BY media_id) AS pos FROM vectors),
n AS (SELECT a.block, a.face_id, a.pos, coalesce(list(b.face_id) FILTER (WHERE b.face_id IS NOT NULL), []::BIGINT[]) AS near FROM f a LEFT JOIN f b ON a.block = b.block AND b.face_id < a.face_id AND round(list_cosine_similarity(a.v, b.v), 12) >= CAST(0.3 AS DOUBLE) GROUP BY a.block, a.face_id, a.pos),
r AS (SELECT block, 0 AS step, []::BIGINT[] AS leaders FROM (SELECT DISTINCT block FROM f)
  UNION ALL SELECT r.block, r.step + 1, CASE WHEN list_has_any(n.near, r.leaders) THEN r.leaders ELSE list_append(r.leaders, n.face_id) END FROM r JOIN n ON n.block = r.block AND n.pos = r.step + 1),
l AS (SELECT block, max_by(leaders, step) AS leaders FROM r GROUP BY block),
p AS (SELECT n.block, n.face_id, CASE WHEN list_contains(l.leaders, n.face_id) THEN n.face_id ELSE list_min(list_intersect(n.near, l.leaders)) END AS leader FROM n JOIN l USING (block))
SELECT block, face_id, leader FROM (SELECT *, count(*) OVER (PARTITION BY block, leader) AS size FROM p) WHERE size >= 2"""


@query("vectors", sql=LEADERS_SQL)
def face_clusters(vectors):
    """At 0.3, as the fixture's vectors are nearly random."""
    return faceindex.leader_clusters(vectors.select(F.col("region").alias("block"), F.col("media_id").alias("face_id"), "vector"), least=0.3)


def _diverse_sql(k: int = 3) -> str:
    """One pair of CTEs a round: what is chosen, and how near it is to what is left."""
    parts = ["r0 AS (SELECT region, media_id, vector::DOUBLE[] AS vector, (media_id % 10) / CAST(10 AS DOUBLE) AS score, 1e0 AS near FROM vectors)"]
    for i in range(1, k + 1):
        parts.append(f"c{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(1 - near, 12) DESC, score DESC, media_id) AS pos FROM r{i - 1}) WHERE pos = 1)")
        parts.append(f"r{i} AS (SELECT r.region, r.media_id, r.vector, r.score, least(r.near, list_cosine_similarity(r.vector, c.vector)) AS near FROM r{i - 1} r JOIN c{i} c ON r.region = c.region AND r.media_id <> c.media_id)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT region, media_id, CAST({i} AS INTEGER) AS rank FROM c{i}" for i in range(1, k + 1))


@query("vectors", sql=_diverse_sql())
def diverse_selection(vectors):
    return clusters.diverse(vectors.withColumn("score", (F.col("media_id") % 10) / 10.0), ["region"], 3)


THEMES_SQL = """WITH RECURSIVE f AS (SELECT CAST(floor(media_id / 25) AS BIGINT) AS cluster, media_id, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY floor(media_id / 25) ORDER BY media_id) AS pos, count(*) OVER (PARTITION BY floor(media_id / 25)) AS n FROM vectors),
s AS (SELECT a.cluster, a.pos, list(list_cosine_similarity(a.v, b.v) ORDER BY b.pos) AS near FROM f a JOIN f b USING (cluster) GROUP BY a.cluster, a.pos),
r AS (SELECT cluster, 0 AS step, []::BIGINT[][] AS themes FROM (SELECT DISTINCT cluster FROM f)
  UNION ALL SELECT cluster, step + 1, CASE WHEN k > 0 THEN list_transform(range(1, len(themes) + 1), lambda i: CASE WHEN i = k THEN list_append(themes[i], step + 1) ELSE themes[i] END) ELSE list_append(themes, [step + 1]) END
  FROM (SELECT r.*, coalesce(list_position(list_transform(r.themes, lambda t: list_avg(list_transform(t, lambda m: s.near[m])) >= CAST(0.2 AS DOUBLE)), true), 0) AS k FROM r JOIN s ON s.cluster = r.cluster AND s.pos = r.step + 1)),
t AS (SELECT cluster, list_filter(max_by(themes, step), lambda x: len(x) >= 3) AS themes FROM r GROUP BY cluster),
p AS (SELECT f.cluster, f.media_id, CASE WHEN f.n < 6 OR len(t.themes) = 0 THEN 1 ELSE coalesce(list_position(list_transform(t.themes, lambda x: list_contains(x, f.pos)), true), 0) END AS k FROM f JOIN t USING (cluster))
SELECT cluster, media_id, CAST(k - 1 AS INTEGER) AS theme FROM p WHERE k > 0"""


@query("vectors", sql=THEMES_SQL)
def sub_themes(vectors):
    """At 0.2, as the fixture's vectors are nearly random; clusters of 25 items."""
    return clusters.sub_themes(vectors.withColumn("cluster", F.floor(F.col("media_id") / 25)), ["cluster"], least=0.2)


@query("tags", sql="SELECT tag_id, media_id, label FROM (SELECT *, row_number() OVER (PARTITION BY media_id, lower(label) ORDER BY confidence DESC, tag_id) AS pos FROM tags) WHERE pos = 1")
def best_detections(tags):
    return stats.best_detections(tags).select("tag_id", "media_id", "label")


@query("media", sql="SELECT media_id FROM media WHERE NOT (media_id % 2 = 0 AND media_id % 3 <> 0)")
def feedback_filter(media):
    """Without what was marked irrelevant for a query, however it was spelled."""
    marks = media.select("media_id", F.when(F.col("media_id") % 2 == 0, "  Beach   SUNSET ").otherwise("dogs").alias("query"), (F.col("media_id") % 3 == 0).alias("liked"))
    return filters.without_disliked(media, marks, "beach sunset").select("media_id")


@query("media", "tags", "faces", "texts", sql="SELECT what, n, round(n / CAST((SELECT count(*) FROM media) AS DOUBLE), 9) AS share FROM (SELECT 'tags' AS what, count(*) AS n FROM media WHERE media_id IN (SELECT media_id FROM tags) UNION ALL SELECT 'faces', count(*) FROM media WHERE media_id IN (SELECT media_id FROM faces) UNION ALL SELECT 'texts', count(*) FROM media WHERE media_id IN (SELECT media_id FROM texts))")
def index_coverage(media, tags, faces, texts):
    return stats.coverage_by(media, {"tags": tags, "faces": faces, "texts": texts}).select("what", "n", F.round("share", 9).alias("share"))


@query("faces", "people", sql="WITH m AS (SELECT f.face_id, min(p.person_id) AS target FROM faces f JOIN people p ON p.person_id = f.person_id % 5 + 1 AND p.status = 'active' WHERE f.face_id % 7 = 0 GROUP BY f.face_id) SELECT f.face_id, coalesce(m.target, f.person_id) AS person_id FROM faces f LEFT JOIN m USING (face_id)")
def faces_moved(faces, people):
    moves = faces.where("face_id % 7 = 0").select("face_id", (F.col("person_id") % 5 + 1).alias("into"))
    return clusters.moved_faces(faces, moves, people).select("face_id", "person_id")


@query("faces", "people", sql="SELECT face_id, CASE WHEN f.person_id % 4 = 0 AND p.status = 'active' THEN NULL ELSE f.person_id END AS person_id FROM faces f LEFT JOIN people p USING (person_id)")
def faces_of_deleted(faces, people):
    return clusters.deleted_people(faces, people, people.where("person_id % 4 = 0"))[0].select("face_id", "person_id")


@query("faces", "people", sql="SELECT person_id, CASE WHEN person_id % 4 = 0 AND status = 'active' THEN 'deleted' ELSE status END AS status FROM people")
def people_deleted(faces, people):
    return clusters.deleted_people(faces, people, people.where("person_id % 4 = 0"))[1].select("person_id", "status")


@query("faces", "people", sql="SELECT count(*) AS n_faces, 0 AS n_named, 0 AS n_people FROM faces")
def people_reset(faces, people):
    kept, nobody = clusters.reset_people(faces, people)
    return kept.agg(F.count("*").alias("n_faces"), F.count("person_id").cast("int").alias("n_named")).crossJoin(nobody.agg(F.count("*").cast("int").alias("n_people")))  # one row each


@query("moments", sql=EVENTS_SQL + ", s AS (SELECT owner || ':' || event AS event, min(created) AS start FROM k GROUP BY k.owner, k.event), c AS (SELECT a.event AS x, b.event AS y, greatest(3e-1, least(1e0, 1 - floor(date_diff('microsecond', a.start, b.start) / 6e7) / 144e1)) AS sure FROM s a JOIN s b ON (a.start < b.start OR (a.start = b.start AND a.event < b.event)) AND date_diff('microsecond', a.start, b.start) < 90000000000) SELECT relation, count(*) AS n, round(sum(sure), 3) AS total FROM (SELECT 'events_close_in_time' AS relation, sure FROM c UNION ALL SELECT 'events_close_in_time', sure FROM c) GROUP BY relation")
def graph_event_times(moments):
    """Of all owners: their number grows as the square of the events', so they are counted and not made."""
    by = timeline.events(moments).groupBy(F.concat_ws(":", F.col("owner").cast("string"), F.col("event").cast("string")).alias("event")).agg(F.min("created").alias("start"))
    return graph.both_ways(graph.close_event_totals(by)).groupBy("relation").agg(F.sum("weight").alias("n"), F.round(F.sum(F.col("confidence") * F.col("weight")), 3).alias("total"))


@query("moments", "segments", sql=EVENTS_SQL + ", a AS (SELECT DISTINCT owner, event, media_id FROM k), b AS (SELECT DISTINCT owner, event, person_id FROM k), c AS (SELECT DISTINCT video_id, person_id FROM segments WHERE person_id % 3 <> 0), d AS (SELECT DISTINCT video_id, label FROM segments), nn AS (SELECT ['memory_contains_media', 'media_in_memory'] AS r, (SELECT count(*) FROM a) AS n UNION ALL SELECT ['memory_contains_person', 'person_in_memory'], (SELECT count(*) FROM b) UNION ALL SELECT ['media_contains_person', 'person_appears_in_media'], (SELECT count(*) FROM c) UNION ALL SELECT ['media_has_label', 'label_appears_in_media'], (SELECT count(*) FROM d)) SELECT unnest(r) AS relation, n FROM nn")
def graph_memories_and_segments(moments, segments):
    rows = timeline.events(moments).withColumn("memory_id", F.concat_ws(":", F.col("owner").cast("string"), F.col("event").cast("string")))
    person = F.when(F.col("person_id") % 3 == 0, F.concat(F.lit("face:"), F.col("person_id").cast("string"))).otherwise(F.col("person_id").cast("string"))
    seen = graph.segment_edges(segments.select("video_id", F.array(person).alias("people"), F.array("label").alias("labels")))
    return graph.both_ways(graph.memory_edges(rows, rows).unionByName(seen)).groupBy("relation").agg(F.count("*").alias("n"))


# The front end.


@query("media", sql="SELECT media_id FROM media WHERE created >= TIMESTAMP '1998-01-01 00:00:00' AND created <= TIMESTAMP '1998-12-31 23:59:59' AND coalesce(quality, 0) >= 0.7 AND coalesce(blur, 1) <= 0.3")
def parsed_phrase(media):
    p = parse("sharp photos in 1998", NOW)
    spec = filters.MediaFilter(date_from=p.date_from, date_to=p.date_to, min_quality=p.min_quality, max_blur=p.max_blur)
    return filters.structured(media, spec, nulls="lenient").select("media_id")



@query(
    "media",
    sql="""SELECT media_id, CASE media_id % 3 WHEN 1 THEN 'bicycle' ELSE '' END AS labels, CASE media_id % 3 WHEN 1 THEN 'car' WHEN 2 THEN 'person' ELSE '' END AS excluded,
    strftime(created, '%Y-01-01') AS day, CASE WHEN media_id % 3 <> 2 THEN CAST(0.7 AS DOUBLE) END AS quality FROM media""",
)
def parsed_phrases(media):
    """What the front end makes of a phrase for each item, parsed in batches."""
    year = F.date_format("created", "yyyy")
    phrase = F.when(F.col("media_id") % 3 == 0, F.concat(F.lit("sharp photos in "), year)).when(F.col("media_id") % 3 == 1, F.concat(F.lit("not blurry bikes in "), year, F.lit(" minus cars"))).otherwise(F.concat(F.lit("beach in "), year, F.lit(" without people")))
    rows = media.select("media_id", parsed_column(phrase, NOW).alias("p"))
    return rows.select("media_id", F.array_join("p.labels", ",").alias("labels"), F.array_join("p.exclude_labels", ",").alias("excluded"), F.date_format("p.date_from", "yyyy-MM-dd").alias("day"), F.col("p.min_quality").alias("quality"))


ALBUM_JSON = '{"kind": "photo", "min_quality": 0.5, "labels": ["NO"], "date_from": "1996-05-01T00:00:00", "unknown": 1}'


@query("media", "tags", sql="SELECT media_id FROM media WHERE kind = 'photo' AND quality >= 0.5 AND created >= TIMESTAMP '1996-05-01 00:00:00' AND media_id IN (SELECT media_id FROM tags WHERE lower(label) = 'no')")
def smart_album(media, tags):
    return filters.structured(media, filters.MediaFilter.from_json(ALBUM_JSON), tags=tags).select("media_id")


def _history(turns: DataFrame) -> DataFrame:
    """Queries by whole text."""
    words = turns.select(text.normalized_query(F.col("text")).alias("query"), (F.lit(STREAM_NOW).cast("timestamp_ntz") - F.make_dt_interval(F.col("conv_id") % 300)).alias("at"))
    return words.groupBy("query").agg(F.count("*").alias("times"), F.max("at").alias("last"))


HISTORY_SQL = f"h AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query, count(*) AS times, max({STREAM_NOW_SQL} - to_days(CAST(conv_id % 300 AS INTEGER))) AS last FROM turns GROUP BY 1)"


@query("turns", sql=f"WITH {HISTORY_SQL} SELECT query, times, last FROM h ORDER BY last DESC, query LIMIT 5")
def recent_queries(turns):
    return retrieval.recent_queries(_history(turns))


@query("turns", sql=f"WITH {HISTORY_SQL}, r AS (SELECT query FROM h ORDER BY last DESC, query LIMIT 5) SELECT query, times FROM h WHERE query NOT IN (SELECT query FROM r) ORDER BY times DESC, last DESC, query LIMIT 5")
def rediscovered_queries(turns):
    return retrieval.popular_but_not_recent(_history(turns)).select("query", "times")


@query("turns", sql=f"WITH {HISTORY_SQL} SELECT query, times FROM h WHERE month(last) = 1 ORDER BY times DESC, last DESC, query LIMIT 5")
def seasonal_queries(turns):
    return retrieval.seasonal_queries(_history(turns), 1).select("query", "times")


@query("turns", sql=f"WITH {HISTORY_SQL} SELECT query, times FROM h ORDER BY times DESC, last DESC, query LIMIT 20")
def kept_history(turns):
    return filters.keep_history(_history(turns), 20).select("query", "times")


RELATED_SQL = """WITH m AS (SELECT *, (media_id * 2654435761 % 4294967296) & 4278255360 AS hi, (media_id * 40503 % 4294967296) & 16711935 AS lo FROM media),
s AS (SELECT * FROM m WHERE media_id = 2), d AS (SELECT m.media_id, m.album = s.album AS same, m.person_id = s.person_id AS person,
2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - m.lng) / 2), 2)))) AS km,
abs(date_diff('hour', s.created, m.created)) AS hours, bit_count(xor(m.hi, s.hi)) + bit_count(xor(m.lo, s.lo)) AS bits FROM m, s WHERE m.media_id <> 2)
SELECT media_id, round(score, 6) AS score FROM (SELECT media_id, 0.3 * CAST(same AS DOUBLE) + 0.25 * CAST(person AS DOUBLE) + 0.2 * coalesce(CASE WHEN km < 1 THEN 1.0 WHEN km < 10 THEN 1 - (km - 1) / 9 ELSE 0.0 END, 0) + CASE WHEN hours < 1 THEN 0.15 WHEN hours < 24 THEN 0.15 * (1 - hours / CAST(24 AS DOUBLE)) WHEN hours < 168 THEN 0.05 * (1 - (hours - 24) / CAST(144 AS DOUBLE)) ELSE 0 END + CASE WHEN bits < 10 THEN 0.1 * (1 - bits / CAST(64 AS DOUBLE)) ELSE 0 END AS score FROM d) WHERE score >= 0.36"""


@query("media", sql=RELATED_SQL)
def related_items(media):
    rows = media.selectExpr("media_id", "album AS event", "array(person_id) AS people", "lat", "lng", "created", "(media_id * 2654435761 % 4294967296) & 4278255360 AS hi", "(media_id * 40503 % 4294967296) & 16711935 AS lo")
    found = retrieval.related(rows, rows.where("media_id = 2"), least=0.36)
    return found.select("media_id", F.round("score", 6).alias("score"))


@query("media", sql="SELECT media_id, array_to_string(list_transform(list_sort(list_filter([{'s': -coalesce(quality, 0), 'n': 'quality'}, {'s': coalesce(blur, 1) - 1, 'n': 'sharpness'}], lambda x: x.s < 0)), lambda x: x.n), ',') AS reasons FROM media")
def explained_signals(media):
    rows = media.select("media_id", F.coalesce("quality", F.lit(0.0)).alias("quality"), (1 - F.coalesce("blur", F.lit(1.0))).alias("sharpness"))
    return retrieval.explained(rows, ["quality", "sharpness"]).select("media_id", F.array_join(F.transform("reasons", lambda x: x["signal"]), ",").alias("reasons"))


@query("timeline", sql=_sessions_sql("gap >= 14400000000") + ' SELECT owner, start, "end", n FROM b')
def window_sessions(timeline_):
    """The batch form of the streaming sessions, which end a gap after their last row."""
    by = timeline_.groupBy("owner", F.session_window("ts", "4 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return by.select("owner", "start", "end", "n")


@query("timeline", sql="SELECT date_trunc('day', ts) AS start, kind, count(*) AS n FROM timeline GROUP BY 1, 2")
def daily_counts(timeline_):
    return timeline_.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


@query("segments", sql="SELECT video_id, n, bytes, round(bytes / sum(bytes) OVER (), 9) AS share FROM (SELECT video_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS bytes FROM segments GROUP BY video_id)")
def video_storage(segments):
    return video.storage(segments.select("video_id", (F.col("end_ms") - F.col("start_ms")).alias("bytes"))).select("video_id", "n", "bytes", F.round("share", 9).alias("share"))


@query("media", "faces", "people", sql="SELECT DISTINCT CAST(media_id AS VARCHAR) AS source, concat('p', person_id) AS target FROM faces WHERE person_id IN (SELECT person_id FROM people WHERE status <> 'active')")
def graph_orphans(media, faces, people):
    """Edges to people who were merged away."""
    person = F.concat(F.lit("p"), F.col("person_id").cast("string"))
    nodes = graph.entities(media, "media", F.col("media_id"), F.col("media_id")).unionByName(graph.entities(people.where("status = 'active'"), "person", person, F.col("name")))
    return graph.orphan_edges(nodes, graph.edges(faces, "media_contains_person", F.col("media_id"), person)).select("source", "target")


@query("faces", "moments", sql=EVENTS_SQL + ", fp AS (SELECT DISTINCT k.owner || ':' || k.event AS event, fc.person_id FROM faces fc JOIN k USING (media_id)) SELECT CAST(a.person_id AS VARCHAR) AS source, CAST(b.person_id AS VARCHAR) AS target, CAST(count(*) AS DOUBLE) AS weight FROM fp a JOIN fp b ON a.event = b.event AND a.person_id < b.person_id GROUP BY a.person_id, b.person_id")
def people_at_events(faces, moments):
    """Pairs of people by the number of events both attended."""
    marked = timeline.events(moments).select("media_id", F.concat_ws(":", F.col("owner").cast("string"), F.col("event").cast("string")).alias("event"))
    return graph.together(faces.join(marked, "media_id"), "event", "people_same_event").select("source", "target", "weight")


@query("tags", "media", sql="SELECT media_id, label FROM tags WHERE NOT (media_id % 10 = 0 AND label = 'AF') AND label <> 'RF' GROUP BY ALL")
def corrected_tags(tags, media):
    wrong = media.where("media_id % 10 = 0").select("media_id", F.lit("AF").alias("label")).unionByName(media.limit(1).select(F.lit(None).cast("long").alias("media_id"), F.lit("RF").alias("label")))
    return filters.corrected(tags, wrong).select("media_id", "label").distinct()


@query("faces", "people", sql="SELECT media_id, CASE WHEN p.status = 'merged' THEN 1 ELSE f.person_id END AS person_id FROM faces f JOIN people p USING (person_id)")
def people_merged(faces, people):
    into = people.where("status = 'merged'").select("person_id", F.lit(1).cast("long").alias("into"))
    return clusters.merged_people(faces, into).select("media_id", F.col("person_id").cast("long").alias("person_id"))
