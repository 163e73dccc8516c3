"""Timed jobs, merged tables, and EXIF heads."""

import os
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumentrail.sources import exif, merging, tables
from lumentrail.streaming import jobs, series

T0 = datetime(2024, 5, 1, 12)
EVENTS = "job_id long, event string, at timestamp_ntz, message string"


def _replayed(spark, tmp_path, batches, **options):
    """All changes of a stream whose files are the batches, one after the other."""
    folder = str(tmp_path / "in")
    jobs.with_rocksdb(spark)
    os.makedirs(folder)
    stream = series.source(spark, folder, spark.createDataFrame([], EVENTS).schema)
    out = []
    query = jobs.timed_jobs(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        query.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
    return [(j, s, t, round((a - T0).total_seconds()), r) for j, _, s, t, a, r in sorted(out, key=lambda x: (x[0], x[4], x[1]))]


def _at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_failed_jobs_wait_and_silent_ones_time_out(spark, tmp_path):
    batches = [
        [(1, "start", _at(0), None), (1, "fail", _at(5), "network"), (2, "start", _at(0), None), (3, "start", _at(1), None), (3, "fail", _at(2), "MODEL_NOT_READY: faces"), (9, "submit", _at(0), None)],
        [(9, "submit", _at(8), None)],  # moves the watermark past the first wait
        [(1, "start", _at(9), None), (1, "fail", _at(10), "network"), (9, "submit", _at(1000), None)],  # and past the second, and job 2's run
        [(1, "start", _at(1001), None), (1, "fail", _at(1002), "network"), (2, "complete", _at(1003), None), (9, "cancel", _at(1003), None)],
        [(1, "start", _at(1010), None), (9, "start", _at(2000), None)],
    ]
    got = _replayed(spark, tmp_path, batches)
    assert [x[1:] for x in got if x[0] == 1] == [
        ("pending", 0, 0, "submit"), ("running", 0, 0, "start"), ("waiting", 1, 5, "network"), ("pending", 1, 7, "retry"),
        ("running", 1, 9, "start"), ("waiting", 2, 10, "network"), ("pending", 2, 14, "retry"), ("running", 2, 1001, "start"), ("failed", 3, 1002, "network"),
    ]
    assert [x[1:] for x in got if x[0] == 2][:4] == [("pending", 0, 0, "submit"), ("running", 0, 0, "start"), ("waiting", 1, 900, "timeout"), ("pending", 1, 902, "retry")]
    assert "completed" not in {x[1] for x in got if x[0] == 2}  # it had timed out
    assert [x[1:] for x in got if x[0] == 3][-1] == ("failed", 1, 2, "MODEL_NOT_READY: faces")
    assert [x[1] for x in got if x[0] == 9] == ["pending", "cancelled"]


def test_jobs_do_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = sorted(((j, rnd.choice(["start", "start", "fail", "complete", "submit"]), _at(rnd.randrange(3000)), "x") for j in range(12) for _ in range(9)), key=lambda r: (r[2], r[0], r[1]))
    want = []
    for j in range(12):
        mine = sorted((r for r in rows if r[0] == j), key=lambda r: (r[2], r[1]))
        job = jobs.Job()
        for _, event, at, message in mine:
            want += [(j, *c[1:3], round(c[3] / 1000)) for c in job.met(event, int((at - T0).total_seconds() * 1000), message, jobs.Rules())]
    for k, size in enumerate((len(rows), 30)):
        where = tmp_path / str(k)
        got = _replayed(spark, where, [rows[i : i + size] for i in range(0, len(rows), size)], late="1 hour")
        assert sorted(x[:4] for x in got if x[4] != "submit") == sorted(want)


def test_final_states_are_forgotten_after_their_lifetime(spark, tmp_path):
    batches = [[(1, "start", _at(0), None), (1, "complete", _at(1), None)], [(2, "submit", _at(100), None)], [(2, "submit", _at(101), None)], [(1, "submit", _at(102), None)]]
    got = _replayed(spark, tmp_path, batches, rules=jobs.Rules(keep_ms=10_000))
    assert [x[1] for x in got if x[0] == 1] == ["pending", "running", "completed", "pending"]


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_merge_rewrites_touched_buckets_once(spark, tmp_path):
    path = str(tmp_path / "edges")
    edge = "relation string, source string, target string, confidence double, weight double, evidence string, updated timestamp_ntz"
    rows = lambda ids, w: spark.createDataFrame([("r", str(i), "t", 0.5 + i / 1000, w, f"e{w}", T0 + timedelta(days=w)) for i in ids], edge)
    keys = ["relation", "source", "target"]
    assert len(merging.merge(path, rows(range(200), 1.0), keys, 0, tables.upsert_edges, buckets=16)) == 16
    before = _files(path)
    touched = merging.merge(path, rows([3, 4, 777], 2.0), keys, 1, tables.upsert_edges, buckets=16)
    after = _files(path)
    assert 1 <= len(touched) <= 3
    same = {f for f in before if not any(f"__bucket={b}/" in f for b in touched)}
    assert same and all(after[f] == before[f] for f in same)
    table = {r.source: r.weight for r in merging.merged(spark, path).collect()}
    assert len(table) == 201 and table["3"] == table["4"] == 3.0 and table["777"] == 2.0 and table["5"] == 1.0
    assert merging.merge(path, rows([3, 4, 777], 2.0), keys, 1, tables.upsert_edges, buckets=16) == []  # the batch comes again
    assert _files(path) == after


def test_merge_ends_what_a_stopped_run_began(spark, tmp_path):
    path, keys = str(tmp_path / "sums"), ["k"]
    add = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("v").alias("v"))
    rows = spark.createDataFrame([(i, 1) for i in range(100)], "k long, v long")
    merging.merge(path, rows, keys, 0, add, buckets=8)
    half = rows.where(F.pmod(F.xxhash64("k"), F.lit(8)) < 4)
    done = merging.merge(path, half, keys, 1, add, buckets=8)  # as if the run had written these buckets alone
    assert sorted(done + merging.merge(path, rows, keys, 1, add, buckets=8)) == list(range(8))
    assert {r.v for r in merging.merged(spark, path).collect()} == {2}


def test_merging_stream_and_empty_batches(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "table")
    for day in range(3):
        spark.createDataFrame([(i, day) for i in range(day, 10)], "media_id long, v int").coalesce(1).write.mode("append").parquet(folder)
    stream = series.source(spark, folder, "media_id long, v int")
    put = lambda a, b: tables.upsert(a, b, ["media_id"], [F.col("v")])
    merging.merging(stream, path, ["media_id"], put, str(tmp_path / "c"), buckets=4).start().awaitTermination()
    assert sorted(map(tuple, merging.merged(spark, path).collect())) == [(0, 0), (1, 1), *((i, 2) for i in range(2, 10))]
    assert merging.merge(path, spark.createDataFrame([], "media_id long, v int"), ["media_id"], 99, put, buckets=4) == []


def test_tables_change_together(spark, tmp_path):
    root = str(tmp_path / "graph")
    one = {"nodes": spark.range(3), "edges": spark.range(5)}
    assert merging.publish(root, one, 1)
    spark.range(9).write.parquet(f"{root}/nodes/version=2")  # a run that stopped before its manifest
    assert merging.published(spark, root)["nodes"].count() == 3
    assert merging.publish(root, {"nodes": spark.range(7), "edges": spark.range(8)}, 2)
    assert not merging.publish(root, one, 2) and not merging.publish(root, one, 1)
    now = merging.published(spark, root)
    assert (now["nodes"].count(), now["edges"].count()) == (7, 8)


def _tiff(order, image, photo=(), place=()):
    """A TIFF head of (tag, type, values) entries."""
    o = {"II": "<", "MM": ">"}[order]
    out = bytearray(order.encode() + struct.pack(o + "HI", 42, 8))

    def directory(entries):
        at = len(out)
        out.extend(bytes(2 + 12 * len(entries) + 4))
        struct.pack_into(o + "H", out, at, len(entries))
        for i, (tag, kind, values) in enumerate(entries):
            data = values.encode() + b"\0" if kind == 2 else struct.pack(o + exif.TYPES[kind] * (len(values) // len(exif.TYPES[kind])), *values)
            count = len(data) if kind == 2 else len(values) // len(exif.TYPES[kind])
            struct.pack_into(o + "HHI", out, at + 2 + 12 * i, tag, kind, count)
            if len(data) <= 4:
                out[at + 10 + 12 * i : at + 10 + 12 * i + len(data)] = data
            else:
                struct.pack_into(o + "I", out, at + 10 + 12 * i, len(out))
                out.extend(data)
        return at

    subs = [(tag, e) for tag, e in ((0x8769, photo), (0x8825, place)) if e]
    main = directory([*image, *((tag, 4, [0]) for tag, _ in subs)])
    for i, (_, entries) in enumerate(subs):
        struct.pack_into(o + "I", out, main + 10 + 12 * (len(image) + i), directory(entries))
    return bytes(out)


def _jpeg(tiff):
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF\0".ljust(14, b"\0") + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0pixels"


IMAGE = [(0x010F, 2, "Maker"), (0x0110, 2, "M-1"), (0x0112, 3, [6])]
PHOTO = [(0x829A, 5, [1, 250]), (0x829D, 5, [28, 10]), (0x8827, 3, [400]), (0x9003, 2, "2021:07:03 08:09:10"), (0xA002, 4, [4000]), (0xA003, 3, [3000])]
PLACE = [(1, 2, "S"), (2, 5, [33, 1, 30, 1, 3600, 100]), (3, 2, "E"), (4, 5, [151, 1, 12, 1, 0, 1])]


def test_exif_source_reads_heads_of_both_byte_orders(spark, tmp_path):
    files = {f"a/{o}.jpg": _jpeg(_tiff(o, IMAGE, PHOTO, PLACE)) for o in ("II", "MM")}
    whole = files["a/II.jpg"]
    loop = bytearray(_tiff("II", IMAGE, PHOTO))
    loop[8 + 2 + 12 * 3 + 8 : 8 + 2 + 12 * 3 + 12] = struct.pack("<I", 8)  # the photo directory leads back to the first
    files |= {"b/cut.jpg": whole[:40], "b/loop.jpg": _jpeg(bytes(loop)), "b/zero.jpg": _jpeg(_tiff("MM", [], [(0x829D, 5, [1, 0])])), "c/empty": b"", "c/text.txt": b"no image", "c/plain.jpg": b"\xff\xd8\xff\xda\0\0", "d/own.tif": _tiff("MM", IMAGE)}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(exif.ExifSource)
    read = spark.read.format("exif").option("filesPerPartition", "3").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 3
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in read.collect()}
    assert set(got) == set(files) and all(r.size == len(files[p]) for p, r in got.items())
    for order in ("II", "MM"):
        r = got[f"a/{order}.jpg"]
        assert (r.make, r.model, r.orientation, r.iso, r.width, r.height, r.taken) == ("Maker", "M-1", 6, 400, 4000, 3000, datetime(2021, 7, 3, 8, 9, 10))
        assert (r.exposure, r.aperture, r.lat, r.lng) == pytest.approx((0.004, 2.8, -33.51, 151.2))
    assert got["b/loop.jpg"].make == "Maker" and got["d/own.tif"].model == "M-1" and got["b/zero.jpg"].aperture is None
    for name in ("b/cut.jpg", "c/empty", "c/text.txt", "c/plain.jpg"):
        assert all(x is None for x in got[name][4:])
    (tmp_path / "none").mkdir()
    assert spark.read.format("exif").load(str(tmp_path / "none")).count() == 0


def test_exif_tags_never_raise_on_any_bytes():
    rnd, whole = random.Random(6), _tiff("II", IMAGE, PHOTO, PLACE)
    for _ in range(3000):
        broken = bytearray(whole[: rnd.randrange(len(whole))])
        for _ in range(rnd.randrange(6)):
            if broken:
                broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        exif.row_of("p", 0, exif.tags_of(bytes(broken)))
