"""Queries over stored tables, indexes and states: each builds what it reads, as a job would over days, and then asks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.functions.tables import register
from lumentrail.operators import clusters, filters, graph, retrieval, stats, timeline
from lumentrail.operators.lineage import scratch
from lumentrail.plans.catalog import EVENTS_SQL, NOW, ORACLES, QUERIES, query
from lumentrail.sources import merging, spatial, tables, textindex
from lumentrail.streaming import jobs

__all__ = ["ORACLES", "QUERIES"]  # the registry of ``catalog``, with these queries

#: A job's state after each of its events, for SQL: (status, tries, due), the rules of ``jobs.Rules`` spelled out.
_WAIT = "greatest(1000, least(30000, 2000 * ({0})))"
_PASSED = f"""CASE WHEN s.status = 'waiting' AND s.due <= e.at THEN {{'status': 'pending', 'tries': s.tries, 'due': -1, 'at': e.at, 'event': e.event}}
 WHEN s.status = 'running' AND s.due <= e.at AND s.tries + 1 >= 3 THEN {{'status': 'failed', 'tries': s.tries + 1, 'due': -1, 'at': e.at, 'event': e.event}}
 WHEN s.status = 'running' AND s.due <= e.at AND s.due + {_WAIT.format("s.tries + 1")} <= e.at THEN {{'status': 'pending', 'tries': s.tries + 1, 'due': -1, 'at': e.at, 'event': e.event}}
 WHEN s.status = 'running' AND s.due <= e.at THEN {{'status': 'waiting', 'tries': s.tries + 1, 'due': s.due + {_WAIT.format("s.tries + 1")}, 'at': e.at, 'event': e.event}}
 ELSE {{'status': s.status, 'tries': s.tries, 'due': s.due, 'at': e.at, 'event': e.event}} END"""
_MET = f"""CASE WHEN p.event = 'start' AND p.status = 'pending' THEN {{'status': 'running', 'tries': p.tries, 'due': p.at + 900000, 'at': p.at, 'event': ''}}
 WHEN p.event = 'fail' AND p.status IN ('running', 'pending') THEN {{'status': CASE WHEN p.tries + 1 >= 3 THEN 'failed' ELSE 'waiting' END, 'tries': p.tries + 1, 'due': CASE WHEN p.tries + 1 >= 3 THEN -1 ELSE p.at + {_WAIT.format("p.tries + 1")} END, 'at': p.at, 'event': ''}}
 WHEN p.event = 'complete' AND p.status = 'running' THEN {{'status': 'completed', 'tries': p.tries, 'due': -1, 'at': p.at, 'event': ''}}
 WHEN p.event = 'cancel' AND p.status NOT IN ('completed', 'failed', 'cancelled') THEN {{'status': 'cancelled', 'tries': p.tries, 'due': -1, 'at': p.at, 'event': ''}}
 ELSE {{'status': p.status, 'tries': p.tries, 'due': p.due, 'at': p.at, 'event': ''}} END"""
JOBS_SQL = f"""WITH e AS (SELECT media_id % 2000 AS job_id, {{'status': '', 'tries': 0, 'due': CAST(-1 AS BIGINT), 'at': epoch_ms(ts), 'event': CASE kind WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'cancel' ELSE 'submit' END}} AS e FROM timeline),
o AS (SELECT job_id, list(e ORDER BY e.at, e.event) AS es FROM e GROUP BY job_id),
r AS (SELECT job_id, list_reduce(es, lambda s, e: list_transform([{_PASSED}], lambda p: {_MET})[1], {{'status': 'pending', 'tries': 0, 'due': CAST(-1 AS BIGINT), 'at': CAST(0 AS BIGINT), 'event': ''}}) AS s FROM o)
SELECT job_id, s.status AS status, CAST(s.tries AS INTEGER) AS tries FROM r"""


@query("timeline", sql=JOBS_SQL)
def timed_job_outcomes(timeline_: DataFrame) -> DataFrame:
    """What jobs have come to with their last event, on a stream with timers: waits for retries, and runs that take too long."""
    spark, path = jobs.with_rocksdb(timeline_.sparkSession), scratch(timeline_.sparkSession)
    kind = F.col("kind")
    event = F.when(kind == "click", "start").when(kind == "error", "fail").when(kind == "purchase", "complete").when(kind == "signup", "cancel").otherwise("submit")
    events = timeline_.select((F.col("media_id") % 2000).alias("job_id"), event.alias("event"), F.col("ts").alias("at"), F.lit("error").alias("message"))
    events.write.parquet(f"{path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/events")
    changes = jobs.timed_jobs(stream, late="40 days")  # files are in no order of time: nothing is late
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")).start().awaitTermination()
    done = spark.read.parquet(f"{path}/changes")
    last = events.groupBy("job_id").agg(F.max("at").cast("timestamp").alias("last"))
    by_then = done.join(last, "job_id").where(F.col("at") <= F.col("last"))
    return by_then.groupBy("job_id").agg(F.max_by(F.struct("status", "tries"), "step").alias("s")).select("job_id", "s.status", "s.tries")


@query("faces", sql="SELECT CAST(person_id AS VARCHAR) AS target, max(confidence) AS confidence, CAST(2 * count(*) AS DOUBLE) AS weight FROM faces GROUP BY person_id")
def edges_merged(faces: DataFrame) -> DataFrame:
    """``edges_upserted`` as a table that two batches are merged into, the second of which comes twice."""
    path = scratch(faces.sparkSession)
    rows = graph.edges(faces.withColumn("all", F.lit("all")), "seen", F.col("all"), F.col("person_id"), confidence=F.col("confidence"))
    dated = rows.withColumn("evidence", F.lit("face")).withColumn("updated", F.lit(NOW).cast("timestamp_ntz"))
    for batch in (0, 1, 1):
        merging.merge(path, dated, ["relation", "source", "target"], batch, tables.upsert_edges, buckets=16)
    return merging.merged(faces.sparkSession, path).select("target", "confidence", "weight")


@query("media", "trash", sql="SELECT 'media' AS name, count(*) AS n FROM media WHERE media_id NOT IN (SELECT media_id FROM trash) UNION ALL SELECT 'trash', count(*) FROM trash")
def tables_published(media: DataFrame, trash: DataFrame) -> DataFrame:
    """Two tables replaced together: items that were deleted leave one and are in the other."""
    spark, root = media.sparkSession, scratch(media.sparkSession)
    merging.publish(root, {"media": media.select("media_id"), "trash": trash.limit(0)}, 1)
    merging.publish(root, {"media": media.select("media_id").join(trash, "media_id", "left_anti"), "trash": trash}, 2)
    now = merging.published(spark, root)
    return now["media"].agg(F.lit("media").alias("name"), F.count("*").alias("n")).unionAll(now["trash"].agg(F.lit("trash").alias("name"), F.count("*").alias("n")))


@query("vectors", sql="WITH p AS (SELECT region, i, avg(CAST(vector[i] AS DOUBLE)) AS x FROM (SELECT region, vector, unnest(range(1, len(vector) + 1)) AS i FROM vectors) GROUP BY region, i) SELECT region, round(sum(x), 6) AS total, round(max(x), 6) AS most FROM p GROUP BY region")
def mean_vectors_merged(vectors: DataFrame) -> DataFrame:
    """``mean_vectors`` from the states of three parts, kept in a merged table."""
    path = scratch(vectors.sparkSession)
    for batch in range(3):
        states = clusters.mean_states(vectors.where(F.col("media_id") % 3 == batch), ["region"])
        merging.merge(path, states, ["region"], batch, clusters.merged_states, buckets=4)
    found = clusters.means_of(merging.merged(vectors.sparkSession, path))
    return found.select("region", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("vector"), 6).alias("most"))


@query("texts", "media")
def text_search_indexed(texts: DataFrame, media: DataFrame) -> DataFrame:
    """``text_only_search`` from a stored index."""
    path = scratch(texts.sparkSession)
    textindex.write_index(texts, path, buckets=16)
    found = textindex.indexed_scores(texts.sparkSession, path, "the idiot")
    return retrieval.top(retrieval.hybrid(None, found, media), 25).select("media_id", F.round("score", 6).alias("score"))


@query("media")
def near_position_stored(media: DataFrame) -> DataFrame:
    """``near_position`` from a table in the order of cells."""
    path = scratch(media.sparkSession)
    spatial.write_by_cell(media.select("media_id", "lat", "lng"), path, files=16)
    near = spatial.in_stored_box(media.sparkSession.read.parquet(path), -10.0, 0.0, 30.0, 40.0)
    return filters.in_box(near, 10.0, 20.0, 20.0).select("media_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("moments")
def overview_sketched(moments: DataFrame) -> DataFrame:
    """Rows exactly, and owners, items and people within the sketches' error, from daily states of two parts."""
    columns, path = ["owner", "media_id", "person_id"], scratch(moments.sparkSession)
    rows = moments.select("created", *(F.col(c).cast("long").alias(c) for c in columns))
    for batch in range(2):
        states = stats.daily_sketches(rows.where(F.col("media_id") % 2 == batch), F.to_date("created"), columns)
        merging.merge(path, states, ["day"], batch, stats.merged_sketches, buckets=8)
    return stats.sketched_counts(merging.merged(moments.sparkSession, path))


_COUNTS = {
    "media_contains_person": "(SELECT count(*) FROM fa)", "media_taken_at_place": "(SELECT count(*) FROM pl)", "media_has_label": "(SELECT count(*) FROM (SELECT DISTINCT media_id, label FROM tags))", "media_in_album": "(SELECT count(*) FROM media)",
    "person_visited_place": "(SELECT count(*) FROM (SELECT DISTINCT person_id, place FROM fa JOIN pl USING (media_id)))", "people_co_occurs": "(SELECT count(*) FROM (SELECT DISTINCT a.person_id, b.person_id FROM fa a JOIN fa b ON a.media_id = b.media_id AND a.person_id < b.person_id))",
    "media_in_event": "(SELECT count(*) FROM ev)", "event_attended_by_person": "(SELECT count(*) FROM fe)", "event_at_place": "(SELECT count(*) FROM (SELECT DISTINCT event, place FROM ev JOIN pl USING (media_id)))",
    "people_same_event": "(SELECT count(*) FROM (SELECT DISTINCT a.person_id, b.person_id FROM fe a JOIN fe b ON a.event = b.event AND a.person_id < b.person_id))", "memory_contains_media": "(SELECT count(*) FROM ev)", "memory_contains_person": "(SELECT count(*) FROM fe)",
    "events_close_in_time": "(SELECT count(*) FROM st a JOIN st b ON a.owner = b.owner AND (a.start < b.start OR (a.start = b.start AND a.event < b.event)) AND date_diff('microsecond', a.start, b.start) < 90000000000)",
}
GRAPH_SQL = (
    "WITH moments AS (SELECT media_id, person_id AS owner, created, lat, lng FROM media), " + EVENTS_SQL.removeprefix("WITH ")
    + """, ev AS (SELECT media_id, owner || ':' || event AS event, owner, created FROM k), st AS (SELECT event, owner, min(created) AS start FROM ev GROUP BY 1, 2),
    pl AS (SELECT media_id, printf('%.2f', round(lat, 2)) || ',' || printf('%.2f', round(lng, 2)) AS place FROM media WHERE lat IS NOT NULL AND lng IS NOT NULL), fa AS (SELECT DISTINCT media_id, person_id FROM faces), fe AS (SELECT DISTINCT ev.event, fa.person_id FROM fa JOIN ev USING (media_id)), ct AS ("""
    + " UNION ALL ".join(f"SELECT '{name}' AS relation, {n} AS n" for name, n in _COUNTS.items())
    + "), bo AS (SELECT * FROM ct UNION ALL SELECT other, n FROM ct JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in graph.REVERSES.items()) + ") r(relation, other) USING (relation)) SELECT relation, CAST(sum(n) AS BIGINT) AS n FROM bo GROUP BY relation HAVING sum(n) > 0"
)


def _whole_graph(media: DataFrame, faces: DataFrame, people: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole graph of the catalog, stored; an event is one of a person's."""
    found = timeline.events(media.withColumnRenamed("person_id", "owner"))
    events = found.select("media_id", F.concat_ws(":", F.col("owner").cast("string"), F.col("event").cast("string")).alias("event"), "owner", "created")
    return graph.stored_whole(media, faces, people, tags, events, scratch(media.sparkSession))


@query("media", "faces", "people", "tags", sql=GRAPH_SQL)
def graph_whole(media: DataFrame, faces: DataFrame, people: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges by relation of everything in one graph, both ways."""
    return _whole_graph(media, faces, people, tags)[1].groupBy("relation").agg(F.count("*").alias("n"))


@query("media", "faces", "people", "tags", sql="""WITH w AS (SELECT media_id, person_id, count(*) AS w FROM faces GROUP BY 1, 2), t AS (SELECT media_id, label, count(*) AS w FROM tags GROUP BY 1, 2), f AS (SELECT DISTINCT media_id, person_id FROM faces)
    SELECT 'outgoing' AS what, CAST(person_id AS VARCHAR) AS other, CAST(w AS DOUBLE) AS weight FROM w WHERE media_id = 3
    UNION ALL SELECT 'two_hop', t.label, CAST(sum(w.w * t.w) AS DOUBLE) FROM w JOIN t USING (media_id) WHERE w.person_id = 5 GROUP BY t.label
    UNION ALL SELECT 'together', CAST(b.person_id AS VARCHAR), CAST(count(*) AS DOUBLE) FROM f a JOIN f b ON a.media_id = b.media_id AND a.person_id = 5 AND b.person_id <> 5 GROUP BY b.person_id""")
def graph_lookups_stored(media: DataFrame, faces: DataFrame, people: DataFrame, tags: DataFrame) -> DataFrame:
    """Three look-ups that read a node's row groups of a stored graph: one edge away, two, and people seen together."""
    nodes, links = _whole_graph(media, faces, people, tags)
    one = graph.outgoing(links, "3", relations=["media_contains_person"]).select(F.lit("outgoing").alias("what"), F.col("target").alias("other"), "weight")
    two = graph.two_hop(links, nodes, "5", "person_appears_in_media", "media_has_label", "label", few=100_000).select(F.lit("two_hop").alias("what"), F.col("external_id").alias("other"), "weight")
    near = graph.outgoing(links, "5", relations=["people_co_occurs"]).select(F.lit("together").alias("what"), F.col("target").alias("other"), "weight")
    return one.unionByName(two).unionByName(near)


@query("segments", sql="WITH v AS (SELECT video_id, max(end_ms) AS d FROM segments GROUP BY video_id), n AS (SELECT *, greatest(1, least(12, d // 1000)) AS n FROM v WHERE d > 0), f AS (SELECT video_id, d // n AS part, unnest(range(0, n)) AS i FROM n) SELECT video_id, CAST(i AS INTEGER) AS frame, i * part + part // 2 AS ts_ms, ((i * part + part // 2) // 60000) || ':' || printf('%02d', (i * part + part // 2) // 1000 % 60) AS clock FROM f")
def frames_by_table_function(segments: DataFrame) -> DataFrame:
    """``sampled_frames`` by a table function in Python, joined laterally."""
    spark = segments.sparkSession
    register(spark)
    segments.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")).createOrReplaceTempView("lumentrail_videos")
    return spark.sql("SELECT video_id, t.* FROM lumentrail_videos, LATERAL frame_times(duration_ms, 12, true) t")


for _name, _same in (("text_search_indexed", "text_only_search"), ("near_position_stored", "near_position")):
    ORACLES[_name] = ORACLES[_same]  # the rows of the query that scans
