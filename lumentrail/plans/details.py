"""Queries of single rules: look-ups, suppression, captions, titles, diagnostics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lumentrail.functions import box, encoding, text, vector
from lumentrail.operators import albums, clusters, dedup, filters, graph, retrieval, stats
from lumentrail.plans.catalog import ALBUM_NOW, ALBUMS_SQL, COSINE, HASH_SQL, MEMORIES_SQL, ORACLES, QUERIES, _graph, _hashes, _memory_tables, _query_vector, query
from lumentrail.sources import tables

__all__ = ["ORACLES", "QUERIES"]  # the registry of ``catalog``, with these queries


@query("media", "trash", sql="SELECT media_id, created FROM media WHERE media_id IN (SELECT media_id FROM trash)")
def batch_lookup(media, trash):
    return filters.by_ids(media, trash).select("media_id", "created")


@query("vectors", sql=f"WITH {HASH_SQL} SELECT a.media_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS bits FROM h a, h b WHERE b.media_id = 7 AND a.media_id <> 7 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8")
def duplicates_of_one(vectors):
    return dedup.duplicates_of(_hashes(vectors), 7).select("media_id", "bits")


@query("faces", sql="SELECT CAST(person_id AS VARCHAR) AS target, confidence FROM (SELECT person_id, max(confidence) AS confidence, max(face_id % 60) AS age FROM faces GROUP BY person_id) WHERE age < 59")
def edges_pruned(faces):
    """Edges last touched within 58 days."""
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    rows = faces.groupBy("person_id").agg(F.max("confidence").alias("confidence"), F.max(F.col("face_id") % 60).alias("age"))
    links = rows.select(F.lit("seen").alias("relation"), F.lit("all").alias("source"), F.col("person_id").cast("string").alias("target"), "confidence", (now - F.make_dt_interval("age")).alias("updated"))
    return graph.pruned(links, now - F.expr("INTERVAL 58 DAYS")).select("target", "confidence")


BOX_SQL = "b AS (SELECT tag_id AS box_id, media_id, confidence, CAST(tag_id * 37 % 60 AS DOUBLE) / 100 AS l, CAST(tag_id * 53 % 60 AS DOUBLE) / 100 AS t, CAST(tag_id * 7 % 30 + 10 AS DOUBLE) / 100 AS w, CAST(tag_id * 11 % 30 + 10 AS DOUBLE) / 100 AS h FROM tags)"


def _boxes(tags):
    part = lambda a, m, b: ((F.col("tag_id") * a % m + b).cast("double") / 100)
    return tags.select("media_id", F.col("tag_id").alias("box_id"), "confidence", part(37, 60, 0).alias("left"), part(53, 60, 0).alias("top"), part(7, 30, 10).alias("width"), part(11, 30, 10).alias("height"))


@query("tags", sql=f"""WITH RECURSIVE {BOX_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, box_id) AS pos FROM b WHERE confidence >= CAST(0.25 AS DOUBLE)),
    c AS (SELECT a.media_id, a.pos AS p, b.pos AS q, greatest(0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS shared, a.w * a.h + b.w * b.h AS areas FROM o a JOIN o b ON a.media_id = b.media_id AND a.pos < b.pos),
    s AS (SELECT media_id, p, list(q) AS over FROM c WHERE shared > CAST(0.45 AS DOUBLE) * (areas - shared) GROUP BY media_id, p),
    r AS (SELECT media_id, 0 AS turn, [0]::BIGINT[] AS gone FROM (SELECT DISTINCT media_id FROM o)
      UNION ALL SELECT r.media_id, r.turn + 1, CASE WHEN list_contains(r.gone, r.turn + 1) THEN r.gone ELSE list_concat(r.gone, coalesce(s.over, []::BIGINT[])) END
      FROM r JOIN o ON o.media_id = r.media_id AND o.pos = r.turn + 1 LEFT JOIN s ON s.media_id = r.media_id AND s.p = r.turn + 1),
    d AS (SELECT media_id, max_by(gone, turn) AS gone FROM r GROUP BY media_id)
    SELECT o.media_id, o.box_id FROM o JOIN d USING (media_id) WHERE NOT list_contains(d.gone, o.pos)""")
def boxes_kept(tags):
    """Non-maximum suppression within each item."""
    return clusters.kept_boxes(_boxes(tags), ["media_id"]).select("media_id", "box_id")


@query("tags", sql=f"WITH {BOX_SQL} SELECT box_id, round(greatest(0, l - w * CAST(0.1 AS DOUBLE)), 6) AS l, round(least(1, l + w + w * CAST(0.1 AS DOUBLE)), 6) AS r, round(w * h, 6) AS area FROM b")
def boxes_padded(tags):
    b = F.struct("left", "top", "width", "height")
    rows = _boxes(tags).withColumn("p", box.padded(b))
    return rows.select("box_id", F.round("p.left", 6).alias("l"), F.round(F.col("p.left") + F.col("p.width"), 6).alias("r"), F.round(box.area(b), 6).alias("area"))


@query("media", "tags", sql="SELECT media_id FROM media WHERE kind = 'video' AND quality >= CAST(0.3 AS DOUBLE) AND media_id IN (SELECT media_id FROM tags WHERE lower(label) = 'no')")
def refined_filter(media, tags):
    """A later query's fields in place of the first one's: video for photo."""
    spec = filters.MediaFilter(kind="photo", min_quality=0.3).refined(filters.MediaFilter(kind="video", labels=("NO",)))
    return filters.structured(media, spec, tags=tags).select("media_id")


@query("vectors", sql=f"WITH s AS (SELECT v.media_id, max(CASE WHEN v.region IN (3, 5) THEN greatest(0, least(1, {COSINE} + CAST(0.05 AS DOUBLE))) ELSE {COSINE} END) AS semantic FROM vectors v, vectors q WHERE q.media_id = 7 GROUP BY v.media_id) SELECT media_id, round(semantic, 6) AS semantic FROM s ORDER BY s.semantic DESC, media_id LIMIT 50")
def region_search(vectors):
    """Vectors of the regions that a query names get a boost; as many candidates as are fetched for five results."""
    asked = vectors.crossJoin(_query_vector(vectors))  # one row
    scored = retrieval.vector_scores(asked, F.col("__q"), region_tokens=["3", "5"])
    return retrieval.top(scored, stats.over_fetch(5), "semantic").select("media_id", F.round("semantic", 6).alias("semantic"))


CAPTION_SQL = """WITH s AS (SELECT media_id, string_agg(label, ', ' ORDER BY label) AS labels FROM (SELECT DISTINCT media_id, label FROM tags WHERE confidence > CAST(0.5 AS DOUBLE)) GROUP BY media_id),
f AS (SELECT media_id, count(*) AS n, count(CASE WHEN person_id % 3 <> 0 THEN 1 END) AS p FROM faces GROUP BY media_id)
SELECT media_id, coalesce(nullif(concat_ws(' ', CASE WHEN kind = 'photo' THEN 'Scene: ' || album || ', day.' END, CASE WHEN media_id % 9 = 0 THEN 'Activity: walking.' END, CASE WHEN media_id % 10 = 0 THEN 'Screenshot.' END, CASE WHEN media_id % 14 = 0 THEN 'Document.' END,
 'Contains: ' || labels || '.', CASE WHEN p = 1 THEN '1 person detected.' WHEN p > 1 THEN p || ' people detected.' WHEN f.n > 1 THEN f.n || ' faces detected.' END,
 CASE WHEN media_id % 4 <> 0 THEN concat_ws(' ', 'Taken with M-' || media_id % 5, nullif(concat_ws(', ', CASE WHEN media_id % 3 <> 0 THEN 'at f/' || CAST(views / CAST(2 AS DOUBLE) AS VARCHAR) END, CASE WHEN media_id % 6 <> 0 THEN 'ISO ' || stages END), '')) || '.' END,
 CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN printf('Location: %.4f, %.4f.', lat, lng) END), ''), 'Photo ' || media_id) AS caption FROM media LEFT JOIN s USING (media_id) LEFT JOIN f USING (media_id)"""


@query("media", "tags", "faces", sql=CAPTION_SQL)
def captions(media, tags, faces):
    known = media.select(
        "media_id", "lat", "lng", F.when(F.col("kind") == "photo", F.concat_ws(",", "album", F.lit(" day"), F.lit(" "))).alias("scenes"), F.when(F.col("media_id") % 9 == 0, "walking").alias("activities"),
        (F.col("media_id") % 10 == 0).alias("is_screenshot"), (F.col("media_id") % 14 == 0).alias("is_document"), F.when(F.col("media_id") % 4 != 0, F.concat(F.lit("M-"), (F.col("media_id") % 5).cast("string"))).otherwise("").alias("camera"),
        F.when(F.col("media_id") % 3 != 0, F.col("views") / 2.0).alias("aperture"), F.when(F.col("media_id") % 6 != 0, F.col("stages")).alias("iso"),
    )
    return albums.captions(known, tags, faces.withColumn("person_id", F.when(F.col("person_id") % 3 != 0, F.col("person_id"))))


TITLE_SQL = "CASE WHEN CAST(start AS DATE) = CAST(finish AS DATE) THEN strftime(start, '%A, %B %-d') WHEN month(start) = month(finish) THEN strftime(start, '%B %-d') || '–' || strftime(finish, '%-d') ELSE strftime(start, '%B %-d') || ' – ' || strftime(finish, '%B %-d') END"


@query("moments", "vectors", sql=MEMORIES_SQL + f""", t AS (SELECT *, owner * 1000 + event AS memory_id, CASE WHEN CAST(start AS DATE) <> CAST(finish AS DATE) AND located > 0 THEN 'trip' WHEN located > 0 AND n >= 5 THEN 'event' ELSE 'everyday' END AS theme FROM mem),
    c AS (SELECT owner * 1000 + event AS memory_id, media_id, person_id, greatest(0, least(1, CAST(0.4 AS DOUBLE) * coalesce(quality, 0.5) + CAST(0.15 AS DOUBLE) + CAST(0.15 AS DOUBLE))) - CAST(0.3 AS DOUBLE) + CASE WHEN has_people THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS s FROM k),
    v AS (SELECT memory_id, first(media_id ORDER BY round(s, 9) DESC, media_id) AS cover, array_to_string(list_sort(list_distinct(list(person_id))), ',') AS persons FROM c GROUP BY memory_id)
    SELECT memory_id, theme, concat_ws(' ', CASE theme WHEN 'trip' THEN 'Trip' WHEN 'event' THEN 'Event' END, CASE WHEN located > 0 THEN 'in here' END, {TITLE_SQL}, '2024') AS title, CASE WHEN n > 10 THEN n || ' photos' END AS subtitle, n, round(score, 5) AS score, cover, persons FROM t JOIN v USING (memory_id)""")
def memories_complete(moments, vectors):
    """Memories with titles, covers and people in one table."""
    scored, members, _ = _memory_tables(moments, vectors)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * F.coalesce("quality", F.lit(0.5)) + 0.15 + 0.15)) - 0.3 + F.when(F.col("has_people"), 0.15).otherwise(0.0)
    rows = members.join(moments.select("media_id", "person_id", F.round(quality, 9).alias("cover_score")), "media_id")
    found = albums.completed(scored.drop("theme"), rows, F.lit(ALBUM_NOW).cast("timestamp_ntz"))
    return found.select("memory_id", "theme", "title", "subtitle", "n", F.round("score", 5).alias("score"), "cover", F.array_join(F.transform("persons", lambda p: p.cast("string")), ",").alias("persons"))


@query("moments", "vectors", sql=ALBUMS_SQL + """, ac AS (SELECT category, name FROM al),
    ti AS (SELECT CAST(owner * 1000 + event AS VARCHAR) AS name, concat_ws(' ', 'Trip in here', """ + TITLE_SQL + """, '2024') AS title FROM mem)
    SELECT category, ac.name, CASE category WHEN 'best_of_year' THEN 'Best of ' || ac.name WHEN 'month' THEN strftime(strptime(ac.name || '-01', '%Y-%m-%d'), '%B %Y') || ' Highlights' WHEN 'trip' THEN ti.title WHEN 'person' THEN 'Photos with ' || ac.name ELSE ac.name END AS title FROM ac LEFT JOIN ti ON category = 'trip' AND ti.name = ac.name""")
def album_titles(moments, vectors):
    scored, members, people = _memory_tables(moments, vectors)
    now = F.lit(ALBUM_NOW).cast("timestamp_ntz")
    found = albums.albums(scored.withColumn("active", F.lit(True)), members, people, now).select("category", "name")
    trips = albums.titled(scored.drop("theme"), now).select(F.col("memory_id").cast("string").alias("name"), F.lit("trip").alias("category"), F.col("title").alias("trip"))
    named = found.join(trips, ["category", "name"], "left")
    return named.select("category", "name", albums.album_title(F.col("category"), F.col("name"), F.col("trip")).alias("title"))


STATUSES = ("pending", "running", "completed", "failed", "cancelled")


@query("media", "faces", "tags", "texts", "jobs", "states", sql="""WITH t AS (SELECT count(*) AS total FROM media), a AS (SELECT count(CASE WHEN is_good = 1 THEN 1 END) AS done FROM states)
    SELECT 'table' AS section, 'media' AS name, count(*) AS n, CAST(NULL AS VARCHAR) AS note FROM media UNION ALL SELECT 'table', 'faces', count(*), NULL FROM faces UNION ALL SELECT 'table', 'tags', count(*), NULL FROM tags UNION ALL SELECT 'table', 'texts', count(*), NULL FROM texts
    UNION ALL SELECT 'job', s, (SELECT count(*) FROM jobs WHERE status = s), NULL FROM (VALUES """ + ", ".join(f"('{s}')" for s in STATUSES) + """) v(s)
    UNION ALL SELECT 'analysis', 'analysed', done, '2024-01-30' FROM a UNION ALL SELECT 'analysis', 'not_analysed', total - done, NULL FROM a, t
    UNION ALL SELECT 'analysis', 'coverage', CAST(floor(done / CAST(total AS DOUBLE) * 1000) AS BIGINT), CASE WHEN done / CAST(total AS DOUBLE) < 0.5 AND total > 10 THEN printf('Analysis coverage is low: %.1f%% (%d/%d photos analyzed)', done / CAST(total AS DOUBLE) * 100, done, total) END FROM a, t""")
def diagnostics(media, faces, tags, texts, jobs, states):
    analysed = states.select("media_id", F.when(F.col("is_good") == 1, F.lit(datetime(2024, 1, 30))).alias("analysed"))
    return stats.diagnostics({"media": media, "faces": faces, "tags": tags, "texts": texts}, jobs, analysed, STATUSES)


@query("media", "faces", "people", "tags", sql="""WITH f AS (SELECT media_id, person_id, count(*) AS w, max(confidence) AS c FROM faces GROUP BY 1, 2), n AS (SELECT CAST(media_id AS VARCHAR) AS other, CAST(w AS DOUBLE) AS weight, c AS confidence FROM f WHERE person_id = 5
      UNION ALL SELECT CAST(CASE WHEN a.person_id = 5 THEN b.person_id ELSE a.person_id END AS VARCHAR), CAST(count(*) AS DOUBLE), 1.0 FROM f a JOIN f b ON a.media_id = b.media_id AND a.person_id < b.person_id WHERE 5 IN (a.person_id, b.person_id) GROUP BY 1)
    SELECT other, sum(weight) AS weight, max(confidence) AS confidence, count(*) AS visits FROM n GROUP BY other""")
def graph_neighbours(media, faces, people, tags):
    """What person 5 is linked with: items and people, with visit counts."""
    links = _graph(media, faces, people, tags)[1].where(F.col("relation").isin("media_contains_person", "people_co_occurs"))
    links = links.where((F.col("relation") == "people_co_occurs") | (F.col("target") == "5"))
    return graph.neighbours(links, "5")


@query("turns", sql="SELECT DISTINCT role, list_contains(['dog', 'dogs', 'user', 'users'], role) OR list_contains(['dog', 'dogs', 'user', 'users'], role || 's') AS named FROM turns")
def labels_in_query(turns):
    return turns.select("role").distinct().select("role", text.label_in_query(F.col("role"), ["dog", "dogs", "user", "users"]).alias("named"))


@query("turns", sql="SELECT conv_id, turn FROM (SELECT *, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(conv_id % 300 AS INTEGER)) AS sent FROM turns) WHERE sent >= TIMESTAMP '2024-01-24 00:00:00' ORDER BY sent DESC, conv_id * 1000 + turn DESC LIMIT 100")
def chat_history(turns):
    """At most a hundred messages of the last week."""
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    sent = turns.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), (now - F.make_dt_interval(F.col("conv_id") % 300)).alias("sent"))
    return tables.recent_messages(sent, now).select("conv_id", "turn")


@query("vectors", sql="SELECT media_id, CAST(4 * len(vector) AS INTEGER) AS bytes, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM vectors")
def vectors_as_blobs(vectors):
    """Vectors as bytes and back: nothing of a component is lost."""
    stored = vectors.select("media_id", encoding.to_blob(F.col("vector")).alias("blob"))
    back = stored.withColumn("v", encoding.from_blob(F.col("blob")))
    return back.select("media_id", F.octet_length("blob").alias("bytes"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("vectors", sql=f"SELECT v.media_id, round(greatest(0, least(1, 1 - {COSINE})), 6) AS distance, round(list_inner_product(v.vector::DOUBLE[], v.vector::DOUBLE[]) / list_inner_product(v.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS length FROM vectors v, vectors q WHERE q.media_id = 7")
def vector_distances(vectors):
    asked = vectors.crossJoin(_query_vector(vectors))  # one row
    unit = vector.l2_normalized(F.col("vector"))
    return asked.select("media_id", F.round(vector.cosine_distance(F.col("vector"), F.col("__q")), 6).alias("distance"), F.round(vector.dot(unit, unit), 6).alias("length"))


@query("tags", "vectors", sql="WITH d AS (SELECT media_id, ['NO', 'RF', 'AF', 'AO'][1 + region % 4] AS label FROM vectors) SELECT tag_id FROM tags t WHERE confidence >= CAST(0.5 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM d WHERE d.media_id = t.media_id AND d.label = t.label)")
def regions_missing(tags, vectors):
    """Sure tags of items that have no region vector of their label yet."""
    labels = F.array(*map(F.lit, ("NO", "RF", "AF", "AO")))
    known = vectors.select("media_id", F.get(labels, (F.col("region") % 4).cast("int")).alias("region_label"))
    return filters.with_region_vectors_missing(tags, known).select("tag_id")


@query("media", sql="""WITH m AS (SELECT 'p' || person_id AS id, media_id FROM media WHERE person_id % 3 = 0 UNION ALL SELECT 'y' || year(created) || album, media_id FROM media WHERE media_id % 4 = 0),
    c AS (SELECT id, CAST(count(*) AS DOUBLE) AS score FROM m GROUP BY id),
    o AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS turn FROM c), s AS (SELECT id, media_id, turn, min(turn) OVER (PARTITION BY media_id) AS first FROM m JOIN o USING (id)), g AS (SELECT id, avg(CAST(first < turn AS DOUBLE)) AS shared FROM s GROUP BY id)
    SELECT id, score FROM c JOIN g USING (id) WHERE shared <= CAST(0.7 AS DOUBLE)""")
def candidates_unseen(media):
    """Groups by person and by year and album, less those most of whose items are in better ones."""
    by_person = media.where("person_id % 3 = 0").select(F.concat(F.lit("p"), F.col("person_id").cast("string")).alias("id"), "media_id")
    by_year = media.where("media_id % 4 = 0").select(F.concat(F.lit("y"), F.year("created").cast("string"), F.col("album")).alias("id"), "media_id")
    members = by_person.unionByName(by_year)
    return albums.unseen(members.groupBy("id").agg(F.count("*").cast("double").alias("score")), members).select("id", "score")


@query("tags", sql=f"WITH {BOX_SQL} SELECT box_id, round(least(l, t), 6) AS l, round(least(t, w), 6) AS t, round(greatest(l, t) - least(l, t), 6) AS w, round(greatest(t, w) - least(t, w), 6) AS h FROM b")
def polygon_boxes(tags):
    """The box around the points (left, top) and (top, width)."""
    b = _boxes(tags).withColumn("p", box.of_polygon(F.array("left", "top"), F.array("top", "width")))
    return b.select("box_id", *(F.round(f"p.{c}", 6).alias(c[0]) for c in ("left", "top", "width", "height")))
