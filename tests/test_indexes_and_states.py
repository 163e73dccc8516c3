"""As-of joins, stored indexes, new faces, mergeable states, sub-themes and table functions against brute force."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrail.functions.tables import register
from lumentrail.operators import clusters, dedup, faceindex, filters, stats, video
from lumentrail.operators.asof import asof, max_before
from lumentrail.operators.retrieval import text_scores
from lumentrail.sources import spatial, textindex


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("span", [7, 1000])
def test_asof_is_brute_force(spark, forward, equal, span):
    rnd = random.Random(1)
    left = [(k, rnd.randrange(-40, 60), i) for i in range(120) for k in [rnd.choice("abc")]]
    right = sorted({(k, rnd.randrange(-40, 60)) for _ in range(60) for k in [rnd.choice("abd")]})
    lt, rt = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame([(*r, f"{r}") for r in right], "k string, u long, name string")
    got = {r.i: r.s and (r.s.u, r.s.name) for r in asof(lt, rt, ["k"], "t", "u", forward=forward, equal=equal, span=span).collect()}
    assert len(got) == 120
    for k, t, i in left:
        ok = [u for j, u in right if j == k and ((u > t or (equal and u == t)) if forward else (u < t or (equal and u == t)))]
        want = (min if forward else max)(ok, default=None)
        assert got[i] == (None if want is None else (want, f"{(k, want)}"))


def test_max_before_crosses_stretches(spark):
    rows = [("a", 0, 50), ("a", 5, 9), ("a", 30, 7), ("a", 31, 60), ("b", 99, 1)]
    got = {(r.k, r.t): r.before for r in max_before(spark.createDataFrame(rows, "k string, t long, v long"), ["k"], "t", "v", span=10).collect()}
    assert got == {("a", 0): None, ("a", 5): 50, ("a", 30): 50, ("a", 31): 50, ("b", 99): None}


def test_segments_of_frames_are_brute_force_without_pairs(spark):
    rnd = random.Random(3)
    segments = sorted({(v, s, s + rnd.choice([0, 1, 5, 30])) for _ in range(90) for v, s in [(rnd.randrange(3), rnd.randrange(100))]})
    frames = sorted({(rnd.randrange(4), rnd.randrange(-5, 120)) for _ in range(150)})
    s, f = spark.createDataFrame(segments, "video_id long, start_ms long, end_ms long"), spark.createDataFrame(frames, "video_id long, ts_ms long")
    inside = {(r.video_id, r.ts_ms): (r.start_ms, r.end_ms) for r in video.in_segments(f, s).collect()}
    nearest = {(r.video_id, r.ts_ms): (r.off, r.start_ms, r.end_ms) for r in video.nearest_segment(f, s).collect()}
    want_in = {(v, t): min(x) for v, t in frames if (x := [(a, b) for w, a, b in segments if w == v and a <= t < b])}
    want_near = {(v, t): min(x) for v, t in frames if (x := [(abs(a - t), a, b) for w, a, b in segments if w == v])}
    assert inside == want_in and nearest == want_near
    for df in (video.in_segments(f, s), video.nearest_segment(f, s)):
        joins = [line for line in _plan(df).split("== Optimized")[1].split("== Physical")[0].split("\n") if "Join" in line]
        assert joins and all("__span" in line for line in joins)  # stretches meet their starts; frames never meet segments
    met = sorted((r.video_id, r.start_ms, r.end_ms, r.seg_start, r.seg_end) for r in video.overlaps(s, s, span_ms=9).collect())
    assert met == sorted((v, a, b, c, d) for v, a, b in segments for w, c, d in segments if v == w and c < b and d > a)


TEXTS = [(1, "The idiot sat, there."), (2, None), (3, ""), (4, "IDIOTS!\nbathe"), (5, "nothing"), (6, "the the THE"), (6, "an idiot"), (7, "wither\tthé"), (8, "idi ot"), (9, "x" * 5000 + "the")]


@pytest.mark.parametrize("query", ["the idiot", "THE the", "zebra", "thé x", "", "idiot"])
def test_indexed_scores_are_those_of_the_scan(spark, tmp_path, query):
    texts = spark.createDataFrame(TEXTS, "media_id long, text string").withColumn("bucket", F.lit(1)).groupBy("media_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    textindex.write_index(texts, str(tmp_path), buckets=4)
    got = {tuple(r) for r in textindex.indexed_scores(spark, str(tmp_path), query).collect()}
    assert got == {tuple(r) for r in text_scores(texts, query).collect()}


def test_index_reads_only_the_words_asked_for(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(i, f"common word{i % 300}") for i in range(3000)], "media_id long, text string")
    monkeypatch.setattr(textindex, "BLOCK", 100)
    textindex.write_index(texts, str(tmp_path), buckets=8)
    stored = spark.read.parquet(f"{tmp_path}/postings")
    assert stored.where("word = 'common'").count() > 20 and stored.agg(F.max(F.size("ids"))).first()[0] < 200  # no row holds all ids of a word
    plan = _plan(textindex.found_postings(spark, str(tmp_path), ["word7"]))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and "IN (" in plan
    assert "In(word, [" in plan or "EqualTo(word,word7)" in plan
    monkeypatch.setattr(textindex, "NAMED", 3)
    assert sorted(r.media_id for r in textindex.indexed_scores(spark, str(tmp_path), "word7").collect()) == [i for i in range(3000) if str(i % 300).startswith("7")]


def test_cells_cover_boxes(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(4000)] + [(4000, None, 1.0), (4001, 90.0, 180.0), (4002, -90.0, -180.0), (4003, 95.0, -200.0)]
    table = spark.createDataFrame(rows, "media_id long, lat double, lng double")
    spatial.write_by_cell(table, str(tmp_path / "t"), files=20)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.where("cell is null").count() == 1
    for _ in range(12):
        (a, b), (c, d) = sorted(rnd.uniform(-90, 90) for _ in "ab"), sorted(rnd.uniform(-180, 180) for _ in "ab")
        got = sorted(r.media_id for r in spatial.in_stored_box(stored, a, c, b, d).collect())
        assert got == sorted(i for i, y, x in rows if y is not None and a <= y <= b and c <= x <= d)
        assert len(spatial.cover(a, c, b, d)) <= 32
    assert [r.media_id for r in spatial.in_stored_box(stored, 90, 180, 90, 180).collect()] == [4001]
    assert spatial.in_stored_box(stored, 10, 0, 5, 1).count() == 0
    near = spatial.in_stored_box(stored, 10.0, 20.0, 12.0, 23.0)
    assert "PushedFilters" in _plan(near) and "GreaterThanOrEqual(cell," in _plan(near)
    ranges = spatial.cover(10.0, 20.0, 12.0, 23.0)
    held = [r for r in stored.groupBy(F.input_file_name()).agg(F.min("cell").alias("a"), F.max("cell").alias("b")).collect() if r.a is not None]
    assert sum(any(r.a <= y and x <= r.b for x, y in ranges) for r in held) <= 4  # of 20 files


def test_new_faces_follow_the_most_similar_face_before_them(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8))
    x = (centres[rng.integers(0, 12, 260)] + 0.45 * rng.standard_normal((260, 8))).round(3)
    x[200] = x[20]
    known = [(i, i % 5 + 100, x[i].tolist()) for i in range(60)]
    new = [(1000 + i, x[i].tolist()) for i in range(60, 260)] + [(5, x[3].tolist()), (9000, None), (9001, [0.0] * 8), (9002, [1.0, 2.0]), (9003, [1.0, 2.1]), (9004, [float("nan")] * 8)]
    person, founder, best = {}, {}, {}
    seen = [(i, 0, p, None, np.array(v)) for i, p, v in known]
    for i, v in sorted(new, key=lambda r: r[0]):
        if v is None or not np.isfinite(v).all() or not np.any(v):
            continue
        u, top = np.array(v), None
        for j, turn, p, f, w in seen:
            if len(w) == len(u):
                s = round(float(u @ w / np.linalg.norm(u) / np.linalg.norm(w)), 9)
                if top is None or (-s, turn, j) < top[0]:
                    top = ((-s, turn, j), p, f)
        if top and -top[0][0] >= 0.6:
            person[i], founder[i], best[i] = top[1], top[2], -top[0][0]
        else:
            person[i], founder[i] = None, i
        seen.append((i, 1, person[i], founder[i], u))
    n, k = spark.createDataFrame(new, "face_id long, vector array<double>"), spark.createDataFrame(known, "face_id long, person_id long, vector array<double>")
    for rows, pivots in ((4096, 1024), (7, 5)):
        got = {r.face_id: r for r in faceindex.assigned(n, k, rows=rows, pivots=pivots).collect()}
        assert len(got) == len(new)
        for i in person:
            assert (got[i].person_id, got[i].founder) == (person[i], founder[i])
            assert got[i].similarity == (pytest.approx(best[i], abs=1e-8) if i in best else None)
        for i in (9000, 9001, 9004):
            assert tuple(got[i])[1:] == (None, None, None)
    alone = faceindex.assigned(n, k.limit(0)).collect()
    assert all(r.person_id is None for r in alone) and min(r.founder for r in alone if r.founder) == 5
    assert faceindex.assigned(n.limit(0), k).count() == 0


def test_mean_states_of_parts_merge_to_the_whole(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 % 2], [float(i), float(i * i), 1.0]) for i in range(50)], "media_id long, g string, vector array<double>")
    parts = [clusters.mean_states(rows.where(F.col("media_id") % 3 == i), ["g"]) for i in range(3)]
    merged = clusters.merged_states(clusters.merged_states(parts[0], parts[1]), parts[2])
    whole = {r.g: list(r.vector) for r in clusters.mean_vectors(rows, ["g"]).collect()}
    got = {r.g: list(r.vector) for r in clusters.means_of(merged).collect()}
    assert got.keys() == whole.keys() and all(got[g] == pytest.approx(whole[g]) for g in got)


def test_sketches_stay_within_their_error(spark):
    rows = spark.range(200_000).select(F.expr("date_add(DATE'2024-01-01', int(id % 30))").alias("day"), (F.col("id") % 60_000).alias("who"), F.lit(None).cast("long").alias("none"))
    parts = [stats.daily_sketches(rows.where(F.col("who") % 2 == i), F.col("day"), ["who", "none"]) for i in (0, 1)]
    row = stats.sketched_counts(stats.merged_sketches(*parts)).first()
    assert row.n == 200_000 and abs(row.who - 60_000) < 60_000 * 3 * 0.0082 and row.none == 0
    again = stats.sketched_counts(stats.merged_sketches(stats.merged_sketches(*parts), parts[0])).first()
    assert again.who == row.who  # a sketch that comes twice changes no distinct count


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_best_share_mean_is_that_of_sorted_values(spark, bins):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([0.5, 0.5, rnd.random(), None])) for g in "abc" for _ in range(rnd.choice([1, 10, 63]))] + [("d", 0.25)] * 7 + [("e", None)]
    got = {r.g: r.mean for r in stats.best_share_mean(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins=bins).collect()}
    for g in "abcd":
        values = sorted((v for k, v in rows if k == g and v is not None), reverse=True)
        take = values[: -(-7 * len(values) // 10)]
        assert got.get(g) == (pytest.approx(sum(take) / len(take)) if take else None)
    assert "e" not in got


def test_exact_members_are_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x")], "media_id long, content_hash string")
    assert sorted(map(tuple, dedup.exact_members(df).collect())) == [("x", 1), ("x", 2), ("x", 6)]
    assert [tuple(r) for r in dedup.exact_groups(df).collect()] == [("x", 1, 3)]


def _themes(x, least, least_size):
    """The rule as it is told: theme by theme, over all that is left."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    theme = np.full(len(x), -1)
    if len(x) < 2 * least_size:
        return {i: 0 for i in range(len(x))}
    for i in range(len(x)):
        if theme[i] < 0:
            theme[i], mine = i, [i]
            for j in range(i + 1, len(x)):
                if theme[j] < 0 and np.mean([x[j] @ x[m] for m in mine]) >= least:
                    theme[j] = i
                    mine.append(j)
    sizes = {t: (theme == t).sum() for t in set(theme)}
    kept = [t for t in sorted(sizes) if sizes[t] >= least_size]
    return {i: kept.index(t) for i, t in enumerate(theme) if t in kept} if kept else {i: 0 for i in range(len(x))}


def test_sub_themes_have_no_bound_and_follow_the_rule(spark):
    rng = np.random.default_rng(7)
    groups = {g: rng.standard_normal((n, 3)) for g, n in (("a", 5), ("b", 6), ("c", 80), ("d", 700), ("e", 1))}
    rows = [(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    got = {}
    for r in clusters.sub_themes(spark.createDataFrame(rows, "g string, media_id long, vector array<double>"), ["g"]).collect():
        got.setdefault(r.g, {})[r.media_id] = r.theme
    assert got == {g: _themes(x, 0.6, 3) for g, x in groups.items()}
    big = spark.range(12_000).select(F.lit("x").alias("g"), F.col("id").alias("media_id"), F.array(F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0), F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)).alias("vector"))
    assert sorted(map(tuple, clusters.sub_themes(big, ["g"]).groupBy("theme").count().collect())) == [(0, 6000), (1, 6000)]


def test_table_function_has_columns_by_its_arguments(spark):
    register(spark)
    videos = spark.createDataFrame([(1, 90_500), (2, 800), (3, 0), (4, None), (5, 3_000_000)], "video_id long, duration_ms long")
    videos.createOrReplaceTempView("videos_t")
    two = spark.sql("SELECT video_id, t.* FROM videos_t, LATERAL frame_times(duration_ms, 12, false) t")
    three = spark.sql("SELECT video_id, t.* FROM videos_t, LATERAL frame_times(duration_ms, 12, true) t")
    assert two.columns == ["video_id", "frame", "ts_ms"] and three.columns == [*two.columns, "clock"]
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, video.sample_times(videos).select("video_id", "frame", "ts_ms").collect()))
    assert {r.clock for r in three.where("video_id = 1 and frame = 11").collect()} == {"1:26"}


def test_stored_box_equals_the_scan(spark, sf):
    from lumentrail.sources.fixtures import view

    media = view(spark, sf, "media")
    assert filters.in_box(media, 10.0, 20.0, 20.0).count() > 0


def _leaders(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    leader = np.full(len(u), -1)
    for i in range(len(u)):
        if leader[i] < 0:
            free = np.flatnonzero(leader < 0)
            leader[free[u[free] @ u[i] >= least]] = i
            leader[i] = i
    return leader


def test_leaders_of_large_blocks_in_few_rounds(spark, monkeypatch):
    """20,000 faces, as the rule places them one after the other."""
    rng = np.random.default_rng(8)
    blocks = {b: (rng.standard_normal((n // 25 + 1, 6))[rng.integers(0, n // 25 + 1, n)] + 0.25 * rng.standard_normal((n, 6))).round(4) for b, n in (("a", 20_000), ("b", 300), ("c", 1))}
    rows = [(b, i, v.tolist()) for b, x in blocks.items() for i, v in enumerate(x)] + [("b", 900, [0.0] * 6), ("b", 901, None), ("b", 902, [1.0]), ("b", 903, [2.0])]
    rounds, settle = [], faceindex.settle
    monkeypatch.setattr(faceindex, "settle", lambda df: rounds.append(1) or settle(df))
    got = faceindex.leader_clusters(spark.createDataFrame(rows, "block string, face_id long, vector array<double>"), least=0.95, least_size=1)
    found = {(r.block, r.face_id): r.leader for r in got.collect()}
    want = {(b, i): int(k) for b, x in blocks.items() for i, k in enumerate(_leaders(x, 0.95))}
    assert found == want | {("b", 900): 900, ("b", 901): 901, ("b", 902): 902, ("b", 903): 902}
    assert len(rounds) < 60


def test_graph_lookups_read_a_relation_and_a_source(spark, sf, tmp_path):
    from lumentrail.operators import graph
    from lumentrail.sources.fixtures import view

    media, faces, people, tags = (view(spark, sf, n) for n in ("media", "faces", "people", "tags"))
    nodes, links = graph.stored(*graph.build(media, faces, people, tags), str(tmp_path))
    plan = _plan(graph.outgoing(links, "3", relations=["media_contains_person"]))
    assert "PartitionFilters: [isnotnull(relation" in plan and "EqualTo(source,3)" in plan
    files = links.where("relation = 'media_contains_person'").groupBy(F.input_file_name()).agg(F.min("source").alias("a"), F.max("source").alias("b")).collect()
    assert sum(r.a <= "3" <= r.b for r in files) <= 2


def test_settled_plans_leave_no_shuffle_files(spark):
    """What a settled plan shuffled goes with its job, whether or not the driver collects garbage; the rows stay."""
    from pathlib import Path
    from time import sleep

    from lumentrail.operators.lineage import CLEANUP, settle

    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEANUP)
    settled = settle(spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(100):
        if not files() - before:
            break
        sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP) == setting
    assert settled.where("n = 4").count() == 5_000


def test_a_face_travels_once_to_a_shard(spark, monkeypatch):
    """However many cells may hold a face's like, and however many rounds leaders take: what is dealt grows with faces, not with faces times cells."""
    rng = np.random.default_rng(5)
    faces = spark.createDataFrame([("b", i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 16)))], "block string, face_id long, vector array<float>")
    sent, dealt = [], faceindex._dealt
    monkeypatch.setattr(faceindex, "_dealt", lambda q, *a: sent.append(q.count()) or dealt(q, *a))
    new = faces.where("face_id % 2 = 1").select("face_id", "vector")
    assert faceindex.best_earlier(new, faces.where("face_id % 2 = 0").select("face_id", "vector"), 0.2).count() == 450
    assert sent == [450]
    sent.clear()
    assert faceindex.leader_clusters(faces, least=0.2, least_size=1).count() == 900
    assert sum(sent) <= 2 * 900


def test_close_events_of_all_owners_are_counted(spark):
    """Totals of all pairs, equal times and other owners' events included, as the edges themselves give them."""
    from lumentrail.operators import graph

    rng = np.random.default_rng(3)
    starts = np.concatenate([rng.integers(0, 4 * 86_400, 300) * 1_000_000 + rng.integers(0, 3, 300), [7_000_000] * 3, [7_000_000 + 90_000_000_000, 7_000_000 + 90_000_000_000 - 1]])
    events = spark.createDataFrame([(f"e{i}", int(t)) for i, t in enumerate(starts)], "event string, t long").select("event", F.timestamp_micros("t").cast("timestamp_ntz").alias("start"))
    told = lambda df, n, total: df.select(n, F.round(total, 6)).first()
    got = graph.close_event_totals(events).agg(F.sum("weight").alias("n"), F.sum(F.col("confidence") * F.col("weight")).alias("total"))
    want = graph.close_events(events).agg(F.count("*").alias("n"), F.sum("confidence").alias("total"))
    assert tuple(told(got, "n", "total")) == tuple(told(want, "n", "total"))
    moments = spark.createDataFrame([(i, i % 2, i // 2) for i in range(8)], "media_id long, owner long, at long").selectExpr("media_id", "owner", "cast(timestamp_seconds(at * 60) as timestamp_ntz) as created", "0d as lat", "0d as lng")
    from lumentrail.plans.catalog import graph_event_times

    assert [tuple(r) for r in graph_event_times(moments).collect()] == [("events_close_in_time", 2, 2.0)]  # two owners' events, both ways


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from lumentrail.operators import lineage

    spark.range(1_000).write.parquet(f"{tmp_path}/a b.parquet")
    rows = spark.read.parquet(f"{tmp_path}/a b.parquet")
    assert lineage.spread(rows, "id") is rows
    monkeypatch.setattr(lineage, "TASK_ROWS", 50)
    assert lineage.spread(rows, "id").rdd.getNumPartitions() == 20


def test_edges_of_one_source_are_written_by_several_tasks(spark, tmp_path):
    from lumentrail.operators import graph

    links = graph.edges(spark.range(20_000), "seen", F.lit("all"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = graph.stored(graph.entities(spark.range(5), "media", F.col("id"), F.col("id")), links, str(tmp_path))[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert links.count() == 20_000 and len(links.inputFiles()) > 1


def test_index_rows_hold_blocks_of_texts(spark, tmp_path, monkeypatch):
    """A word's ids come from blocks of texts as they are read; a repeated id counts once, a null one not at all."""
    texts = spark.createDataFrame([(i % 90 if i < 99 else None, "common word") for i in range(100)], "media_id long, text string").coalesce(1)
    textindex.write_index(texts, str(tmp_path), buckets=2)
    rows = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert sorted((r.word, sorted(r.ids)) for r in rows) == [(w, list(range(90))) for w in ("common", "word")]
    assert {r.word: r.n for r in spark.read.parquet(f"{tmp_path}/words").collect()} == {"common": 90, "word": 90}
    assert "block" not in spark.read.parquet(f"{tmp_path}/postings").columns


def _all_dealt_by_rows(df) -> bool:
    """Whether every shuffle of a plan has a number of tasks of its own, whatever the session's partitions."""
    shuffles = [line for line in _plan(df).split("== Physical")[1].split("\n") if "Exchange hashpartitioning" in line]
    return bool(shuffles) and all("REPARTITION_BY_NUM" in line for line in shuffles)


@pytest.fixture
def few_rows_a_task(spark, monkeypatch):
    """Tables of more than 100 rows are dealt; no side is broadcast."""
    from lumentrail.operators import lineage

    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_of_few_tasks_are_dealt_by_rows_too(spark, tmp_path, few_rows_a_task):
    """Also where the session has more shuffle partitions than the table asks for: Spark would join those by their bytes."""
    from lumentrail.operators import lineage
    from lumentrail.sources import tables

    media, tags = spark.range(150).select(F.col("id").alias("media_id")), spark.range(700).select((F.col("id") % 140 + 20).alias("media_id"))
    for name, df in (("media", media), ("tags", tags)):
        df.write.parquet(f"{tmp_path}/{name}")
    media, tags = spark.read.parquet(f"{tmp_path}/media"), spark.read.parquet(f"{tmp_path}/tags")
    assert lineage.spread(media, "media_id") is not media
    found = tables.reconcile(media, tags)
    assert _all_dealt_by_rows(found)
    assert {tuple(r) for r in found.collect()} == {(i, "orphaned") for i in range(20)} | {(i, "missing") for i in range(150, 160)}


def test_pairs_of_people_are_counted_where_they_are_dealt(spark, tmp_path, few_rows_a_task):
    from collections import Counter
    from itertools import combinations

    from lumentrail.operators import graph

    rnd = random.Random(3)
    rows = [(rnd.randrange(120), rnd.choice([None, *range(15)])) for _ in range(600)]
    spark.createDataFrame(rows, "media_id long, person_id long").write.parquet(str(tmp_path / "faces"))
    found = graph.together(spark.read.parquet(str(tmp_path / "faces")))
    assert _all_dealt_by_rows(found)
    people = {m: sorted({p for n, p in rows if n == m and p is not None}) for m, _ in rows}
    want = Counter(pair for p in people.values() for pair in combinations(p, 2))
    assert {tuple(r) for r in found.collect()} == {("people_co_occurs", str(a), str(b), 1.0, float(n)) for (a, b), n in want.items()}
    assert dict(found.dtypes) == {"relation": "string", "source": "string", "target": "string", "confidence": "double", "weight": "double"}


@pytest.mark.parametrize("span", [7, 1000])
def test_nearest_segments_of_tables_dealt_by_rows(spark, tmp_path, few_rows_a_task, span):
    """Frames and segments that repeat, lie in several stretches, or have no video, time or end."""
    rnd = random.Random(span)
    segments = [(rnd.choice([None, 0, 1, 2]), a if (a := rnd.randrange(-20, 100)) % 9 else None, a + rnd.randrange(9)) for _ in range(150)] + [(5, 3, None), (5, 40, None), (5, 40, 47)]
    frames = [(rnd.choice([None, 0, 1, 2, 3]), t if (t := rnd.randrange(-30, 130)) % 11 else None) for _ in range(400)] + [(5, 3), (5, 30), (5, 22)]
    spark.createDataFrame(segments, "video_id long, start_ms int, end_ms long").write.parquet(str(tmp_path / "segments"))
    spark.createDataFrame(frames, "video_id long, ts_ms long").write.parquet(str(tmp_path / "frames"))
    found = video.nearest_segment(spark.read.parquet(str(tmp_path / "frames")), spark.read.parquet(str(tmp_path / "segments")), span_ms=span)
    assert _all_dealt_by_rows(found)
    assert dict(found.dtypes) == {"video_id": "bigint", "ts_ms": "bigint", "start_ms": "int", "end_ms": "bigint", "off": "bigint"}
    near = lambda v, t: [(abs(a - t), a, float("inf") if b is None else b) for w, a, b in segments if w == v and a is not None]
    want = {(v, t): min(x) for v, t in frames if v is not None and t is not None and (x := near(v, t))}
    got = [(r.video_id, r.ts_ms, (r.off, r.start_ms, float("inf") if r.end_ms is None else r.end_ms)) for r in found.collect()]
    assert len(got) == len(want) and {(v, t): s for v, t, s in got} == want


def test_frames_in_segments_of_tables_dealt_by_rows(spark, tmp_path, few_rows_a_task):
    rnd = random.Random(5)
    segments = [(rnd.choice([None, 0, 1, 2]), a, a + rnd.randrange(-2, 9)) for _ in range(120) for a in [rnd.randrange(-20, 100)]] * 2
    frames = [(rnd.choice([None, 0, 1, 2, 3]), rnd.randrange(-30, 130)) for _ in range(400)]
    spark.createDataFrame(segments, "video_id long, start_ms long, end_ms long").write.parquet(str(tmp_path / "segments"))
    spark.createDataFrame(frames, "video_id long, ts_ms long").write.parquet(str(tmp_path / "frames"))
    found = video.in_segments(spark.read.parquet(str(tmp_path / "frames")), spark.read.parquet(str(tmp_path / "segments")))
    assert _all_dealt_by_rows(found)
    want = {(v, t): min(x) for v, t in frames if (x := [(a, b) for w, a, b in segments if w == v and v is not None and a <= t < b])}
    got = [(r.video_id, r.ts_ms, (r.start_ms, r.end_ms)) for r in found.collect()]
    assert len(got) == len(want) and {(v, t): s for v, t, s in got} == want


def _shuffle_files(spark):
    from pathlib import Path

    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for f in d.rglob("shuffle_*.data")}


def _left(spark, before):
    """Shuffle files that are still there after a moment: they are deleted in the background."""
    from time import sleep

    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        sleep(0.1)
    return left


def _odd_catalog(spark, folder):
    """Tables with null ids, confidences and positions, repeated rows, an item in two events, people who are no nodes."""
    rnd = random.Random(6)
    some = lambda *xs: rnd.choice([None, *xs])
    media = [(some(*range(80)), some("a", "b"), some(1.0, 2.0, 2.001), some(5.0, 7.5)) for _ in range(150)] + [(None, "c", 9.0, 9.0)]
    faces = [(some(*range(90)), some(*range(4, 16)), some(0.25, 0.5, 1.0)) for _ in range(500)]
    tags = [(some(*range(80)), some("x", "y", "z"), some(0.5, 0.75)) for _ in range(200)]
    events = [(some(*range(80)), f"{o}:{e}", o, datetime(2020, 1, 1 + e % 5, rnd.randrange(24))) for _ in range(90) for o, e in [(rnd.randrange(3), rnd.randrange(9))]]
    tables = {
        "media": (media, "media_id long, album string, lat double, lng double"), "faces": (faces, "media_id long, person_id int, confidence double"),
        "people": ([(i, f"p{i}") for i in range(9)], "person_id int, name string"), "tags": (tags, "media_id long, label string, confidence double"),
        "events": (events, "media_id long, event string, owner long, created timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    return [spark.read.parquet(f"{folder}/{name}") for name in tables]


@pytest.mark.parametrize("task_rows", [40, 500_000])
def test_whole_graph_is_stored_relation_by_relation(spark, tmp_path, monkeypatch, task_rows):
    """Every node and edge of the graph, while no relation finds shuffle files of those before it, and no part is left."""
    from pathlib import Path

    from lumentrail.operators import graph, lineage

    monkeypatch.setattr(lineage, "TASK_ROWS", task_rows)
    catalog = _odd_catalog(spark, tmp_path)
    before, left, written, parts = _shuffle_files(spark), [], graph._written, str(tmp_path / "parts")
    monkeypatch.setattr(graph, "scratch", lambda _: parts)
    monkeypatch.setattr(graph, "_written", lambda *args: left.append(len(_left(spark, before))) or written(*args))
    nodes, links = graph.stored_whole(*catalog, str(tmp_path / "graph"))
    assert left == [0] * 23 and not _left(spark, before) and not Path(parts).exists()
    want_nodes, want_links = graph.whole(*catalog)
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows(nodes, "type", "external_id", "name") == rows(want_nodes, "type", "external_id", "name")
    edge = ["relation", "source", "target", "confidence", "weight"]
    assert rows(links, *edge) == rows(want_links, *edge)
    assert links.select("relation").distinct().count() == 21 and dict(links.dtypes) == dict(want_links.dtypes)


def test_graph_queries_leave_no_shuffle_files(spark, sf):
    from lumentrail.plans import incremental

    for name in ("graph_whole", "graph_lookups_stored"):
        before = _shuffle_files(spark)
        incremental.QUERIES[name](spark, sf)
        assert not _left(spark, before), name


def test_two_hops_from_one_node_shuffle_no_relation(spark, tmp_path):
    from lumentrail.operators import graph

    seen = graph.edges(spark.range(40), "seen", F.col("id") % 4, F.col("id"))
    named = graph.edges(spark.range(400), "named", F.col("id") % 40, F.col("id") % 7)
    nodes, links = graph.stored(graph.entities(spark.range(7), "label", F.col("id"), F.col("id")), seen.unionByName(named), str(tmp_path))
    joined = lambda few: graph.two_hop(links, nodes, "9x" if few is None else "3", "seen", "named", "label", few=few or 9)
    rows = lambda df: sorted(map(tuple, df.collect()))
    many, some = joined(9), joined(10)
    assert rows(many) == rows(some) == rows(graph.two_hop(links, nodes, "3", "seen", "named", "label")) and joined(None).count() == 0
    assert "ResolvedHint (strategy=broadcast)" in _plan(some) and "ResolvedHint (strategy=broadcast)" not in _plan(many)
