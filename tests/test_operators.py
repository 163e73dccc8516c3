"""Golden values, edge cases and properties of the catalog operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumentrail.functions import encoding, pixels, vector
from lumentrail.functions import tables as sql_tables
from lumentrail.operators import albums, clusters, dedup, faceindex, filters, graph, retrieval, stats, timeline, video
from lumentrail.plans import assistant
from lumentrail.plans.parser import add_months, parse, parsed_column
from lumentrail.sources import tables
from lumentrail.streaming import series

NOW = datetime(2025, 6, 15, 12)
T0 = datetime(2025, 1, 1)


def times(spark, hours, owner="a"):
    return spark.createDataFrame([(i, owner, T0 + timedelta(hours=h)) for i, h in enumerate(hours)], "media_id long, owner string, ts timestamp_ntz")


@pytest.mark.parametrize(
    "text, want",
    [
        ("photos from last week", {"date_from": datetime(2025, 6, 8)}),
        ("photos from yesterday", {"date_from": datetime(2025, 6, 14)}),
        ("photos from today", {"date_from": datetime(2025, 6, 15), "date_to": datetime(2025, 6, 15, 23, 59, 59)}),
        ("photos from 3 days ago", {"date_from": datetime(2025, 6, 12, 12)}),
        ("photos from this month", {"date_from": datetime(2025, 6, 1)}),
        ("photos from 2025-01-15", {"date_from": datetime(2025, 1, 15)}),
        ("photos in 2024", {"date_from": datetime(2024, 1, 1), "date_to": datetime(2024, 12, 31, 23, 59, 59)}),
        ("last Monday", {"date_from": datetime(2025, 6, 9), "date_to": datetime(2025, 6, 9, 23, 59, 59)}),
        ("the day before yesterday", {"date_from": datetime(2025, 6, 13)}),
        ("Jan 15th, 2024", {"date_from": datetime(2024, 1, 15), "date_to": datetime(2024, 1, 15, 23, 59, 59)}),
        ("6/7/2024", {"date_from": datetime(2024, 6, 7)}),
        ("2024-13-45", {"date_from": None}),
        ("from March", {"date_from": datetime(2025, 3, 1), "date_to": datetime(2025, 3, 31, 23, 59, 59)}),
        ("this week", {"date_from": datetime(2025, 6, 9), "date_to": NOW}),
        ("shots with a nikon z6", {"make": "Nikon", "model_contains": "Z6"}),
        ("X-T4 and GFX 100", {"model_contains": "GFX 100"}),
        ("pixel 7 pro", {"make": "Google", "model_contains": "pixel 7 pro"}),
        ("galaxy z fold4", {"make": "Samsung", "model_contains": "galaxy z fold4"}),
        ("high-quality out of focus", {"min_quality": 0.7, "max_blur": 0.3}),
        ("not a screenshot", {"min_quality": 0.3}),
        ("not screenshot", {"min_quality": None}),
        ("near New York in winter", {"location": "New York"}),
        ("cell-phone, hotdogs and wine glass", {"labels": ("cell phone", "wine glass")}),
        ("mans womens", {"labels": ()}),
        ("cave", {"concepts": ("beach", "mountain", "forest", "park", "garden", "ocean", "sea", "lake", "river", "waterfall", "sunset", "sunrise", "sky", "clouds", "desert", "island")}),
        ("foggy", {"concepts": ("rain", "snow", "sunny", "cloudy", "fog", "night", "dark", "bright", "golden hour", "blue hour")}),
        ("golden hour, dogs", {"labels": ("dog",), "semantic": "rain snow sunny cloudy fog night dark bright golden hour blue hour dog"}),
        ("8 months ago", {"date_from": datetime(2024, 10, 15, 12)}),
        ("iPhone 14 photos", {"make": "Apple", "model_contains": "iPhone"}),
        ("Galaxy S24 photos", {"make": "Samsung"}),
        ("sharp photos", {"min_quality": 0.7}),
        ("blurry photos", {"max_blur": 0.6}),
        ("not blurry photos", {"min_quality": 0.7, "max_blur": 0.3}),
        ("not sharp photos", {"max_blur": 0.6}),
        ("puppy", {"labels": ("dog",)}),
        ("my sofa", {"labels": ("couch",)}),
        ("red bike", {"labels": ("bicycle",)}),
        ("dog except cat", {"labels": ("dog",), "exclude_labels": ("cat",)}),
        ("beach without people", {"exclude_labels": ("person",), "labels": ()}),
        ("Sandy sharp photos in Mumbai", {"person": "Sandy", "min_quality": 0.7, "has_location": True}),
        ("Sandy and Siva", {"person": "Sandy"}),
    ],
)
def test_parser(text, want):
    got = parse(text, NOW, ["Sandy", "Thiyan", "Siva"])
    assert {k: getattr(got, k) for k in want} == want


def test_parser_rest():
    got = parse("beach without people", NOW)
    assert "beach" in got.semantic and "people" not in got.semantic
    assert parse("", NOW).intent == "unknown" and parse("dog last week", NOW).intent == "combined"
    assert add_months(datetime(2024, 3, 31), -1) == datetime(2024, 2, 29)


def test_parser_column(spark):
    df = spark.createDataFrame([("puppy",), (None,), ("photos in 2024",)], "q string").select(parsed_column(F.col("q"), NOW).alias("p")).select("p.*")
    got = df.collect()
    assert got[0].labels == ["dog"] and got[2].date_from == datetime(2024, 1, 1)


def test_assistant():
    assert assistant.intent("unfavorite these") == "remove_favorites"
    assert assistant.intent("favorite these") == "add_favorites"
    assert assistant.intent("photos of my country") == "search"
    assert assistant.steps("find dogs and then delete duplicates") == ["find dogs", "delete duplicates"]
    assert assistant.steps("dogs and cats") == ["dogs and cats"]
    assert assistant.refers_back("delete those") and not assistant.allowed("delete", 51) and assistant.allowed("share", 51)


def test_sessions(spark):
    n = lambda hours, **o: timeline.sessions(times(spark, hours), **o).select("session").distinct().count()
    assert n([0, 0.5, 1]) == 1 and n([0, 1, 6, 7]) == 2 and n([0, 4]) == 1
    adaptive = lambda h: timeline.adaptive_sessions(times(spark, h)).select("session").distinct().count()
    assert adaptive([0, 24 + 59 / 60]) == 1 and adaptive([0, 25]) == 2
    two = timeline.session_bounds(timeline.sessions(times(spark, [0, 1, 7, 8])))
    assert timeline.merged_sessions(two, gap_hours=6).first().n == 4
    assert timeline.gaps(times(spark, [10, 11, 20, 21])).count() == 1


def test_event_splits_at_four_hours(spark):
    df = times(spark, [0, 1, 5, 6]).select("media_id", "owner", F.col("ts").alias("created"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    assert timeline.events(df).select("event").distinct().count() == 2


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, None, None)], "media_id long, created timestamp_ntz, quality double, blur double")
    f = filters.MediaFilter(date_from=T0)
    assert filters.structured(df, f).count() == 0 and filters.structured(df, f, nulls="lenient").count() == 1
    assert filters.structured(df, filters.MediaFilter(max_blur=0.9), nulls="lenient").count() == 0


def test_exif(spark):
    df = spark.createDataFrame([("2024:05:06 07:08:09", "1/250"), ("soon", "x"), (None, "2.8")], "t string, r string")
    got = df.select(tables.exif_time(F.col("t")).alias("t"), tables.exif_ratio(F.col("r")).alias("r")).collect()
    assert got[0].t == datetime(2024, 5, 6, 7, 8, 9) and got[1].t is None and [g.r for g in got] == [1 / 250, None, 2.8]


def test_album_query(spark):
    df = spark.createDataFrame([('{"text": "a", "min_quality": 0.5}',), ("{broken",)], "j string").select(tables.album_query(F.col("j")).alias("q")).select("q.*").collect()
    assert df[0].text == "a" and df[0].min_quality == 0.5 and df[1].text is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=12), st.lists(st.integers(0, 63), max_size=8))
def test_hamming_join(spark, hashes, flips):
    hashes = hashes + [hashes[0] ^ sum(1 << f for f in set(flips))]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "media_id long, hi long, lo long")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 8}
    assert {tuple(r) for r in dedup.hamming_pairs(df).collect()} == want


def test_components_and_similarity(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.comp for r in dedup.components(chain).collect()} == {0, 100}
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 3)], "media_id long, hi long, lo long")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, comp long")
    assert dedup.group_similarity(df, groups).first().similarity == pytest.approx(1 - (1 + 2 + 1) / 3 / 64)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [g.c for g in got] == [1, 0, -1, 0, 0] and [g.d for g in got] == [0, 1, 1, 1, 1]


def test_scenes(spark):
    rows = [(1, i * 4000, [1.0, 0.0] if i < 2 else [0.0, 1.0], 20_000) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id long, ts_ms long, vector array<double>, duration_ms long")
    got = sorted((r.start_ms, r.end_ms) for r in video.scenes(df).collect())
    assert got == [(0, 8000), (8000, 20_000)]
    three = spark.createDataFrame([(1, 0, 10_000), (1, 10_000, 12_000), (1, 12_000, 20_000)], "video_id long, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in video.merged_scenes(three).collect()) == [(0, 12_000), (12_000, 20_000)]


def test_faces(spark):
    df = spark.createDataFrame([("b", 1, [0.8, 0.6]), ("b", 2, [0.78, 0.62]), ("b", 3, [-1.0, 0.0])], "block string, face_id long, vector array<double>")
    assert {(r.face_id, r.leader) for r in faceindex.leader_clusters(df).collect()} == {(1, 1), (2, 1)}
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    many = spark.createDataFrame([("b" if i % 2 else "c", i, [float(v) for v in r]) for i, r in enumerate(x)], "block string, face_id long, vector array<double>")
    want, u = {}, x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        want.setdefault(i, i)
        if want[i] == i:
            want.update({j: i for j in range(i, 60) if j % 2 == i % 2 and want.get(j, i) == i and u[i] @ u[j] >= 0.6 and j not in want})
    sizes = {i: list(want.values()).count(i) for i in want.values()}
    for rows in (4096, 4):
        assert {r.face_id: r.leader for r in faceindex.leader_clusters(many, rows=rows).collect()} == {i: k for i, k in want.items() if sizes[k] > 1}
    assert faceindex.leader_clusters(many.limit(0)).count() == 0
    boxes = spark.createDataFrame([("m", 1, 0.9, 0.1, 0.1, 0.5, 0.5), ("m", 2, 0.8, 0.12, 0.1, 0.5, 0.5), ("m", 3, 0.7, 0.7, 0.7, 0.2, 0.2)], "media_id string, box_id long, confidence double, left double, top double, width double, height double")
    assert {r.box_id for r in clusters.kept_boxes(boxes, ["media_id"]).collect()} == {1, 3}


def memory_rows(spark, rows):
    """(cluster, id, hours from T0, lat, lng, people, quality)"""
    df = spark.createDataFrame([(c, i, T0 + timedelta(hours=h), a, b, p, q) for c, i, h, a, b, p, q in rows], "cluster string, media_id long, created timestamp_ntz, lat double, lng double, has_people boolean, quality double")
    return albums.memory_scores(df, ["cluster"], least=0.0)


def test_memory_scores(spark):
    """Five items in four hours: dense enough for 0.625, one day, three of five located near each other, three with people, best four of the qualities."""
    quality = [0.8, 0.9, 0.7, 0.85, 0.75]
    rows = [("a", i, i, 37.7749 + i / 10_000 if i < 3 else None, -122.4194 if i < 3 else None, i in (0, 1, 3), quality[i]) for i in range(5)]
    got = memory_rows(spark, rows).first()
    assert got.score == pytest.approx(0.25 * (0.6 * 0.625 + 0.4) + 0.2 * 1.0 + 0.2 * 1.0 + 0.2 * 0.5 + 0.15 * (0.9 + 0.85 + 0.8 + 0.75) / 4)
    lone = memory_rows(spark, [("b", 1, 0, None, None, None, None)]).first()
    assert lone.score == pytest.approx(0.25 * (0.6 * 0.5 + 0.4) + 0.2 * 0.3 + 0.2 * 0.3 + 0.2 * 0.5 + 0.15 * 0.5)
    wide = memory_rows(spark, [("c", i, 30 * i, 10.0 * i, 0.0, i == 0, 0.5) for i in range(5)]).first()  # five days
    assert wide.score == pytest.approx(0.25 * (0.6 * (5 / 120) / 2 + 0.4 * 0.9) + 0.2 * 0.7 + 0.2 * 0.8 + 0.1 + 0.075)


def test_memory_semantics(spark):
    """The mean cosine of pairs, from the sum of unit vectors."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 4))
    x[4] = 0
    df = spark.createDataFrame([("a", [float(v) for v in r]) for r in x] + [("b", [1.0, 2.0])], "cluster string, vector array<double>")
    got = {r.cluster: r.similarity for r in clusters.mean_cosine(df, ["cluster"]).collect()}
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    assert got["a"] == pytest.approx(np.mean([u[i] @ u[j] for i in range(6) for j in range(i)])) and got["b"] is None


def test_unseen(spark):
    """Of two memories with the same items only the first stays."""
    candidates = spark.createDataFrame([("a", 0.8), ("b", 0.8), ("c", 0.5)], "id string, score double")
    members = spark.createDataFrame([(c, i) for c in "ab" for i in range(5)] + [("c", 4), ("c", 9)], "id string, media_id long")
    assert sorted(r.id for r in albums.unseen(candidates, members).collect()) == ["a", "c"]


def test_titles(spark):
    day = datetime(2025, 6, 15, 10)
    rows = [
        (1, day, day + timedelta(hours=6), 10, None, None, "everyday", "Sunday, June 15"), (2, day, day + timedelta(days=2), 12, None, "Goa", "trip", "Trip in Goa June 15–17"),
        (3, day, day + timedelta(days=20), 3, ["Ann", "Bo"], None, "people", "Ann June 15 – July 5"), (4, day, day, 5, None, "Goa", "event", "Event in Goa Sunday, June 15"), (5, day, day + timedelta(days=40), 2, None, None, "seasonal", "Summer June 15 – July 25"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "id int, start timestamp_ntz, end timestamp_ntz, n long, people array<string>, place string")
    got = {r.id: r for r in albums.titled(df, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert [(got[r[0]].theme, got[r[0]].title) for r in rows] == [r[6:] for r in rows]
    assert got[2].subtitle == "12 photos" and got[1].subtitle is None
    assert albums.titled(df.limit(1), F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz")).first().title == "Sunday, June 15 2025"


def test_frame_times(spark):
    times = lambda f, ms, most=12: [r.ts_ms for r in f(spark.createDataFrame([(1, ms)], "video_id long, duration_ms long"), most=most).orderBy("frame").collect()]
    assert len(times(video.sample_times, 3000, 10)) == 3 and times(video.sample_times, 3000, 10) == [500, 1500, 2500]
    assert times(video.sample_times, 700) == [350] and times(video.sample_times, 0) == []
    assert times(video.adaptive_times, 40_000, 10) == [500, 3833, 7166, 10_500, 14_500, 18_500, 22_500, 26_500, 30_500, 35_500]
    assert times(video.key_moments, 3000) == [2500, 750, 1500]
    assert times(video.key_moments, 60_000, 8) == [2500, 10_000, 15_000, 20_000, 30_000, 40_000, 45_000, 50_000]
    longest = times(video.key_moments, 600_000, 40)
    assert len(longest) == 40 == len(set(longest)) and longest == sorted(longest)


def test_video_quality(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.2), (2, 0, None, None), (2, 1000, None, None), (2, 2000, None, None)], "video_id long, ts_ms long, blur double, quality double")
    got = {r.video_id: r for r in video.quality(df).collect()}
    assert got[1].score == pytest.approx(0.4 * 0.1 + 0.4 * 0.2 + 0.2 * 0.5) and got[1].issues == ["blurry", "low_quality", "few_frames"]
    assert got[2].score == pytest.approx(0.4 * 0.5 + 0.4 * 0.5 + 0.2) and got[2].issues == []


def test_highlights_and_chapter_titles(spark):
    scenes = spark.createDataFrame([(1, 0, 5000, 0.8, None), (1, 5000, 9000, 0.0, "Beach"), (1, 61_000, 62_000, 1.0, None)], "video_id long, start_ms long, end_ms long, confidence double, label string")
    segments = spark.createDataFrame([(1, 0, 2000, ["p"], ["dog", "cat"], "hello"), (1, 2000, 6000, ["p", "q"], ["dog"], None), (1, 8000, 9000, [], [], "")], "video_id long, start_ms long, end_ms long, people array<string>, labels array<string>, ocr_text string")
    videos = spark.createDataFrame([(1, 20_000)], "video_id long, duration_ms long")
    got = video.highlights(scenes.drop("label"), segments, videos).collect()
    assert [(r.start_ms, r.reasons) for r in got] == [(0, ["2 people detected", "Objects: cat, dog", "Text detected on screen"])]
    assert got[0].score == pytest.approx(0.2 + 0.08 + 0.1 + 0.08)  # 5 s is not short beside 6.7 s
    titles = {r.start_ms: r.title for r in video.chapter_titles(scenes.drop("confidence"), segments).collect()}
    assert titles == {0: "People & dog", 5000: "Beach", 61_000: "Scene 01:01"}
    summary = video.summaries(scenes, segments, video.highlights(scenes.drop("label"), segments, videos), videos).first()
    assert tuple(summary) == (1, 20_000, 3, 2, 2, 1, 1)


def test_related_decays(spark):
    cols = "media_id long, event string, people array<string>, lat double, lng double, created timestamp_ntz, hi long, lo long"
    seed = spark.createDataFrame([(0, "e", ["a", "b"], 0.0, 0.0, T0, 0, 0)], cols)
    rows = [(1, "e", ["a"], 0.0, 0.0, T0 + timedelta(minutes=30), 0, 7), (2, "f", ["c"], 0.05, 0.0, T0 + timedelta(hours=12), 1, 1023), (3, None, [], None, None, T0 + timedelta(hours=96), 0, 1)]
    got = {r.media_id: r.score for r in retrieval.related(spark.createDataFrame(rows, cols), seed, least=0.0).collect()}
    km = 0.05 * math.pi / 180 * 6371
    assert got[1] == pytest.approx(0.3 + 0.125 + 0.2 + 0.15 + 0.1 * (1 - 3 / 64))
    assert got[2] == pytest.approx(0.2 * (1 - (km - 1) / 9) + 0.15 * 0.5)
    assert got[3] == pytest.approx(0.05 * 0.5 + 0.1 * (1 - 1 / 64))


def test_covers_and_diversity(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 0.8, False, 1500, 1000), ("g", 2, 0.9, 0.6, True, 1000, 2000), ("g", 3, None, None, None, 0, 0)], "g string, media_id long, quality double, blur double, people boolean, width long, height long")
    scored = df.withColumn("score", clusters.cover_score(F.col("quality"), F.col("blur"), F.col("people"), F.col("width"), F.col("height")))
    assert {r.media_id: round(r.score, 9) for r in scored.collect()} == {1: round(0.36 + 0.24 + 0.15 + 0.1, 9), 2: round(0.36 + 0.18 + 0.15 - 0.3 + 0.15, 9), 3: round(0.2 + 0.15 + 0.15 - 0.3, 9)}
    assert clusters.covers(scored, ["g"]).first().cover == 1
    near = spark.createDataFrame([("g", 1, 0.9, [1.0, 0.0]), ("g", 2, 0.8, [1.0, 0.1]), ("g", 3, 0.1, [0.0, 1.0]), ("h", 4, 0.1, [1.0])], "g string, media_id long, score double, vector array<double>")
    assert sorted(tuple(r) for r in clusters.diverse(near, ["g"], 2).collect()) == [("g", 1, 1), ("g", 3, 2), ("h", 4, 1)]


def test_sub_themes(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("x", i, a if i % 2 else b) for i in range(8)] + [("y", i, a) for i in range(4)] + [("z", i, [float(k == i % 3) for k in range(3)]) for i in range(6)]
    got = clusters.sub_themes(spark.createDataFrame(rows, "g string, media_id long, vector array<double>"), ["g"]).collect()
    parts = {(r.g, r.theme): {x.media_id for x in got if (x.g, x.theme) == (r.g, r.theme)} for r in got}
    assert parts == {("x", 0): {0, 2, 4, 6}, ("x", 1): {1, 3, 5, 7}, ("y", 0): {0, 1, 2, 3}, ("z", 0): set(range(6))}


def test_feedback(spark):
    media = spark.createDataFrame([(1,), (2,), (3,)], "media_id long")
    marks = spark.createDataFrame([(1, " Red  CAR ", False), (2, "red car", True), (3, "car", False)], "media_id long, query string, liked boolean")
    assert sorted(r[0] for r in filters.without_disliked(media, marks, "red car").collect()) == [2, 3]
    assert filters.without_disliked(media, marks, "  ").count() == 3


def test_graph_orphans(spark):
    nodes = spark.createDataFrame([("person", "1", "x"), ("media", "2", "y")], "type string, external_id string, name string")
    links = spark.createDataFrame([("r", "2", "1", 1.0, 1.0), ("r", "2", "9", 1.0, 1.0)], "relation string, source string, target string, confidence double, weight double")
    assert [r.target for r in graph.orphan_edges(nodes, links).collect()] == ["9"]


def test_pixels():
    flat, noisy = np.full((40, 40), 100, np.uint8), np.random.default_rng(0).integers(0, 256, (40, 40)).astype(np.uint8)
    assert pixels.blur_class(flat) == "blurry" and pixels.blur_class(noisy) == "very_sharp"
    assert len(pixels.dct_hash(noisy)) == 16 and pixels.dct_hash(noisy) == pixels.dct_hash(noisy)
    assert pixels.mask_without(np.array([255, 255]), np.array([0, 9])).tolist() == [255, 0]
    assert pixels.greedy_ctc(np.eye(4)[[1, 1, 0, 1, 2]], "abc") == "aab"
    assert (pixels.adjusted(flat) == flat).all() and np.allclose(pixels.box_blur(flat, 2), 100)
    assert pixels.resized(noisy, 10, 10).mean() == pytest.approx(noisy.mean())


def test_quality_of_rasters():
    rng = np.random.default_rng(0)
    dark, bright, mid = (np.full((30, 30), v, np.uint8) for v in (20, 240, 120))
    assert [pixels.exposure_class(x) for x in (dark, bright, mid, np.zeros((0, 0)))] == ["underexposed", "overexposed", "balanced", "unknown"]
    dim = np.where(np.arange(900).reshape(30, 30) % 10 < 6, 40, 130).astype(np.uint8)
    assert pixels.exposure_class(dim) == "slightly_underexposed"
    noisy = rng.integers(0, 256, (60, 60)).astype(np.uint8)
    assert pixels.quality(mid) == pytest.approx(0.2 + 0.15) and pixels.quality(dark) == pytest.approx(0.06 + 0.15)
    assert pixels.quality(noisy) == pytest.approx(0.3 + 0.2 + 0.25 * np.std(noisy) / 80 + 0.1 * pixels.dynamic_range(noisy), abs=0.06) and pixels.noise(noisy) == 1.0
    g = np.zeros((5, 5))
    g[1, 1], g[3, 3] = 8, 4
    assert pixels.noise(g) == pytest.approx(16 / 50)  # of 32, 16, 0 and 0 the upper middle


def test_toned():
    image = np.array([[[200, 100, 50], [10, 20, 30]], [[128, 128, 128], [250, 250, 250]]], np.uint8)
    assert (pixels.toned(image) == image).all()
    assert pixels.toned(image, brightness=0.2)[0, 1].tolist() == [20, 30, 40]
    assert pixels.toned(image, contrast=0.5)[0, 0].tolist() == [229, 89, 19]
    assert pixels.toned(image, temperature=1.0)[1, 0].tolist() == [158, 125, 98] and pixels.toned(image, tint=-1.0)[1, 0].tolist() == [119, 158, 119]
    assert pixels.toned(image, highlights=-1.0)[1, 1].max() < 180 and (pixels.toned(image, highlights=-1.0)[0, 1] == image[0, 1]).all()
    assert pixels.toned(image, shadows=1.0)[0, 1].min() > 80 and (pixels.toned(image, blacks=1.0)[1, 1] == image[1, 1]).all()
    assert pixels.toned(image, saturation=-1.0)[0, 0].tolist() == [124] * 3 and (pixels.toned(image, whites=1.0)[1, 0] == image[1, 0]).all()
    skin, sky = (np.full((2, 2, 3), c, np.uint8) for c in ([200, 150, 120], [120, 150, 200]))
    change = lambda x: int(np.abs(pixels.toned(x, vibrance=1.0).astype(int) - x).sum())
    assert change(skin) < change(sky)
    both = pixels.toned(image, exposure=0.3, contrast=0.5)
    assert (both == pixels.toned(pixels.toned(image, exposure=0.3), contrast=0.5)).mean() > 0.7
    edge = np.repeat(np.where(np.arange(40) < 20, 80, 160)[None, :, None], 40, axis=0).repeat(3, axis=2).astype(np.uint8)
    assert pixels.toned(edge, clarity=1.0).max() > 160 and pixels.toned(edge, sharpness=1.0).min() < 80 and pixels.toned(edge, vignette=-1.0)[0, 0].max() < 80
    with pytest.raises(ValueError):
        pixels.toned(image, glow=1.0)


def test_screens_and_pages():
    screen = np.full((1000, 500, 3), 30, np.uint8)
    screen[300:700, 100:400] = np.random.default_rng(0).integers(0, 256, (400, 300, 3))
    assert pixels.screenshot_score(screen) == pytest.approx((0.8 + 0.9 + 1.0 + 0.8) / 4)
    page = np.full((1414, 1000, 3), 250, np.uint8)
    page[40:1380:28, 100:900] = 20
    page[41:1380:28, 100:900] = 20
    assert pixels.document_score(page) >= (0.9 + 0.6 + 0.1 + 0.5) / 4 - 0.1 and pixels.document_score(np.random.default_rng(1).integers(0, 256, (90, 400, 3))) < 0.3
    assert pixels.looks_like_screen(1080, 2340) is True or pixels.looks_like_screen(1080, 2000) and not pixels.looks_like_screen(1600, 1200)
    assert pixels.looks_like_page(2100, 2970) and not pixels.looks_like_page(1920, 1080)


def test_encoder_protocol(spark):
    class LetterCounts:
        dims = 3

        def encode(self, items):
            x = np.array([[t.count(c) for c in "abc"] for t in items], float)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    df = spark.createDataFrame([("aab",), (None,), ("c",)], "t string").select(encoding.encoded(F.col("t"), LetterCounts()).alias("v"))
    got = [r.v for r in df.collect()]
    assert got[0] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5), 0]) and got[1] is None and got[2] == [0, 0, 1]


def test_sample_times_in_sql(spark):
    sql_tables.register(spark)
    videos = spark.createDataFrame([(1, 3000), (2, 60_000), (3, 0), (4, 500)], "video_id long, duration_ms long")
    videos.createOrReplaceTempView("some_videos")
    got = spark.sql("SELECT video_id, t.frame, t.ts_ms FROM some_videos, LATERAL sample_times(duration_ms, 12) t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, video.sample_times(videos).collect()))


def test_stored_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("person", "1", "x")], "type string, external_id string, name string")
    links = spark.createDataFrame([("r", "2", "1", 1.0, 1.0), ("s", "2", "9", 1.0, 1.0)], "relation string, source string, target string, confidence double, weight double")
    _, read = graph.stored(nodes, links, str(tmp_path / "g"))
    one = graph.outgoing(read, "2", relations=["r"])
    assert [r.target for r in one.collect()] == ["1"] and "PartitionFilters: [" in one._jdf.queryExecution().toString()
    assert stats.over_fetch(1) == 50 and stats.over_fetch(100) == 1000 and stats.over_fetch(9999) == 2000


def test_plans(spark, sf):
    """Filters and columns reach the scan; top-k is one operator; no Python in relational plans."""
    from lumentrail.plans.catalog import QUERIES

    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    strict = plan("strict_filter")
    assert "PushedFilters: [" in strict and "GreaterThanOrEqual" in strict and "o_comment" not in strict
    assert "TakeOrderedAndProject" in plan("similar_items")
    for name in ("strict_filter", "overview", "sessions", "people_together", "hybrid_search"):
        assert "Python" not in plan(name) and "Pandas" not in plan(name), name


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS media_id", "user_id AS owner", "ts", "event_type AS kind")
    folder = str(tmp_path / "in")
    events.where("owner < 20").write.parquet(folder)
    stream = series.source(spark, folder, events.schema)
    series.written(series.session_counts(stream), "sessions_s", "append", str(tmp_path / "c1")).start().awaitTermination()
    batch = timeline.session_bounds(timeline.sessions(events.where("owner < 20")))
    done = spark.table("sessions_s")
    assert 0 < done.count() <= batch.count() and done.count() >= batch.count() - 60
    series.written(series.status_counts(stream, "kind"), "kinds_s", "complete", str(tmp_path / "c2")).start().awaitTermination()
    assert {tuple(r) for r in spark.table("kinds_s").collect()} == {tuple(r) for r in events.where("owner < 20").groupBy("kind").count().collect()}


def test_job_states(spark, tmp_path):
    rows = [(1, "start", T0), (1, "fail", T0 + timedelta(1)), (2, "start", T0), (2, "complete", T0 + timedelta(1)), (2, "fail", T0 + timedelta(2))]
    spark.createDataFrame(rows, "job_id long, event string, at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = series.source(spark, str(tmp_path / "in"), "job_id long, event string, at timestamp_ntz")
    series.written(series.job_states(stream), "jobs_s", "update", str(tmp_path / "c")).start().awaitTermination()
    last = {r.job_id: (r.status, r.tries) for r in spark.table("jobs_s").collect()}
    assert last[2] == ("completed", 0) and last[1][0] in ("pending", "running")
