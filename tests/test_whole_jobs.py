"""Whole jobs: no query reads a part of its view."""

from pyspark.sql import functions as F

from lumentrail.plans import catalog
from lumentrail.sources.fixtures import view


def test_distances_of_every_located_item(spark, sf):
    located = view(spark, sf, "moments").where("lat is not null")
    assert catalog.QUERIES["distances"](spark, sf).count() == located.count() - located.select("owner").distinct().count()
    assert catalog.QUERIES["distances_to_position"](spark, sf).count() == view(spark, sf, "media").where("lat is not null").count()


def test_segments_of_every_video(spark, sf):
    segments = view(spark, sf, "segments")
    assert catalog.QUERIES["segments_in_range"](spark, sf).count() == segments.where("start_ms < 9000 and end_ms > 5000").count()
    for name in ("adaptive_frames", "sampled_frames", "key_moments"):
        assert catalog.QUERIES[name](spark, sf).select("video_id").distinct().count() == segments.where("end_ms > 0").select("video_id").distinct().count()


def test_queries_are_whole_texts(spark):
    long = "the same beginning, "
    rows = [(1, 1, "user", long + "one end"), (2, 1, "user", long + "another end"), (3, 1, "user", long.upper() + "  another   END ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in catalog.query_log(turns).collect()] == [(long + "another end", 2), (long + "one end", 1)]
    assert [tuple(r) for r in catalog.query_suggestions(turns).collect()] == [(long + "another end", 2), (long + "one end", 1)]
    assert {r.query for r in catalog.recent_queries(turns).collect()} == {long + "another end", long + "one end"}
    assert catalog.rediscovered_queries(turns).count() == 0
    assert [tuple(r) for r in catalog.seasonal_queries(turns).collect()] == [(long + "another end", 2), (long + "one end", 1)]


def test_days_left_of_all_trash(spark, sf):
    rows = catalog.QUERIES["trash_days_left"](spark, sf)
    assert rows.count() == view(spark, sf, "trash").count() and rows.where("days_left = 0").count() > 0
    assert rows.where("days_left = 0").join(view(spark, sf, "trash").where(F.col("deleted") < catalog.now() - F.expr("INTERVAL 200 DAYS")), "media_id").count() > 0
