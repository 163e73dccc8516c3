"""Scenes, segments and frames of videos as interval and sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.functions.time import clock
from lumentrail.functions.vector import cosine_distance
from lumentrail.operators.asof import asof, max_before
from lumentrail.operators.lineage import spread, tasks


def fixed_segments(videos: DataFrame) -> DataFrame:
    """``video_id, start_ms, end_ms``: segments of 10, 15, 30 or 60 s for videos of up to 30 s, 2 min, 5 min and longer; the last is cut."""
    length = F.when(F.col("duration_ms") <= 30_000, 10_000).when(F.col("duration_ms") <= 120_000, 15_000).when(F.col("duration_ms") <= 300_000, 30_000).otherwise(60_000)
    starts = videos.where("duration_ms > 0").select("video_id", "duration_ms", length.cast("long").alias("step")).select("video_id", "duration_ms", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.col("step"))).alias("start_ms"))
    return starts.select("video_id", "start_ms", F.least(F.col("start_ms") + F.col("step"), F.col("duration_ms")).alias("end_ms"))


def _frame_count(most: int) -> Column:
    """Frames of a video: one a second, ``most`` at most, one at least."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("duration_ms") / 1000))).cast("int")


def _frames(videos: DataFrame, times: Column) -> DataFrame:
    """``video_id, frame, ts_ms`` of arrays of times."""
    return videos.where("duration_ms > 0").select("video_id", F.posexplode(times).alias("frame", "ts_ms"))


def _even(start: Column, span: Column, n: Column, shift: Column) -> Column:
    """``n`` times from ``start``, spread over ``span``."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (start + F.floor(span * i / n) + shift).cast("long"))


def sample_times(videos: DataFrame, *, most: int = 12) -> DataFrame:
    """Frames in the middle of equal parts of a video (``duration_ms``)."""
    n = _frame_count(most)
    part = F.floor(F.col("duration_ms") / n)
    return _frames(videos, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * part + F.floor(part / 2)).cast("long")))


def adaptive_times(videos: DataFrame, *, most: int = 12) -> DataFrame:
    """Frames by quarters, half a second in: 30 % of them in the first, 50 % in the two after it, the rest in the last (each at least one, cut to the number there are)."""
    n, quarter, late = _frame_count(most), F.floor(F.col("duration_ms") / 4), F.lit(500)
    early, middle = (F.greatest(F.lit(1), F.floor(n * share + 0.5).cast("int")) for share in (0.3, 0.5))
    last = F.greatest(F.lit(1), n - early - middle)
    times = F.concat(_even(F.lit(0), quarter, early, late), _even(quarter, quarter * 2, middle, late), _even(quarter * 3, quarter, last, late))
    return _frames(videos, F.slice(F.array_sort(times), F.lit(1), n))


def key_moments(videos: DataFrame, *, most: int = 12) -> DataFrame:
    """Frames at 2.5 s, at each quarter and 5 s before the end; while more are wanted, all is divided evenly by one part more than there are frames."""
    d, n = F.col("duration_ms"), _frame_count(most)
    first = F.array(F.lit(2500).cast("long"), *(F.floor(d * share).cast("long") for share in (0.25, 0.5, 0.75)), F.greatest(F.lit(0).cast("long"), d - 5000))

    def fuller(times: Column, _: Column) -> Column:
        parts = F.size(times) + 1
        more = F.transform(F.sequence(F.lit(1), parts), lambda i: (i * F.floor(d / parts)).cast("long"))
        open_ = (F.size(times) < n) & ((F.size(times) == 5) | (F.size(times) < F.floor(d / 1000)))
        return F.when(open_, F.array_sort(F.array_distinct(F.concat(times, more)))).otherwise(times)

    rounds = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))  # each round makes at least twice as many
    return _frames(videos, F.slice(F.aggregate(rounds, first, fuller), F.lit(1), n))


def scenes(frames: DataFrame, *, threshold: float = 0.3, least_ms: int = 1000) -> DataFrame:
    """``video_id, start_ms, end_ms`` between frames whose vectors differ; frames have video_id, ts_ms, vector, duration_ms. Scenes under ``least_ms`` go."""
    w = Window.partitionBy("video_id").orderBy("ts_ms")
    before = F.lag("vector").over(w)
    cut = F.row_number().over(w) == 1
    marked = frames.withColumn("__cut", cut | F.coalesce(cosine_distance(before, F.col("vector")) > threshold, F.lit(False))).withColumn("__first", cut)
    starts = marked.where("__cut").select("video_id", "duration_ms", F.when(F.col("__first"), F.lit(0).cast("long")).otherwise(F.col("ts_ms")).alias("start_ms"))
    ended = starts.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(Window.partitionBy("video_id").orderBy("start_ms")), F.col("duration_ms")))
    return ended.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("video_id", "start_ms", "end_ms")


def merged_scenes(scenes_: DataFrame, *, least_ms: int = 3000) -> DataFrame:
    """Scenes shorter than ``least_ms`` joined to the one before."""
    w = Window.partitionBy("video_id").orderBy("start_ms")
    long_ = ((F.col("end_ms") - F.col("start_ms")) >= least_ms) | (F.row_number().over(w) == 1)
    grouped = scenes_.withColumn("__long", long_.cast("int")).withColumn("scene", F.sum("__long").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("video_id", "scene").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def in_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame with the first segment that holds its time (start included, end not).

    By start and end, only a segment that ends later than all before it can be the
    first to hold a time; the ends of those ascend with their starts, so the one to
    ask is the first that ends after the frame.
    """
    later = max_before(segments.select("video_id", "start_ms", "end_ms"), ["video_id"], "start_ms", "end_ms")
    records = later.where("start_ms < end_ms and (before is null or end_ms > before)").drop("before")
    met = asof(spread(frames.select("video_id", "ts_ms"), "video_id", "ts_ms").distinct(), records, ["video_id"], "ts_ms", "end_ms", forward=True, equal=False)
    return met.where("s.start_ms <= ts_ms").select("video_id", "ts_ms", "s.start_ms", "s.end_ms")


def nearest_segment(frames: DataFrame, segments: DataFrame, *, span_ms: int = 3_600_000) -> DataFrame:
    """Each frame with the segment whose start is nearest, ties to the earlier: the last that starts up to it, or the first after it.

    As in ``asof``, both are put together and sorted within stretches of ``span_ms``, and what lies before and behind
    a stretch comes from windows over one row a stretch. Both ways are one shuffle; frames and segments may repeat.
    """
    keys, start = ["video_id", "__span"], F.when(~F.col("__frame"), F.col("__t"))
    marks = frames.select("video_id", F.col("ts_ms").alias("__t"), F.lit(True).alias("__frame"), F.lit(None).cast(segments.schema["end_ms"].dataType).alias("end_ms"))
    marks = marks.unionAll(segments.select("video_id", F.col("start_ms").alias("__t"), F.lit(False).alias("__frame"), "end_ms")).where("video_id is not null and __t is not null")
    n = 2 * tasks(marks)  # a row is a frame and a segment
    rows = spread(marks.withColumn("__span", F.floor(F.col("__t") / span_ms)), *keys, n=n).groupBy(*keys, "__t", "__frame").agg(F.min("end_ms").alias("end_ms"))

    # At one time a segment comes before a frame, and the other way round from behind.
    upto, back = [F.col("__t"), F.col("__frame")], [F.desc("__t"), F.desc("__frame")]
    last = lambda c, by, order, upper: F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper))
    segment = F.when(start.isNotNull(), F.struct(F.col("__t").alias("start_ms"), "end_ms"))
    local = rows.withColumn("__up", last(segment, keys, upto, 0)).withColumn("__down", last(segment, keys, back, 0)).where("__frame")

    ends = rows.groupBy(*keys).agg(F.max(start).alias("__l"), F.max_by("end_ms", start).alias("__le"), F.min(start).alias("__f"), F.min_by("end_ms", start).alias("__fe"))
    end = lambda t, e: F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("start_ms"), F.col(e).alias("end_ms")))
    beside = spread(ends, "video_id", n=n).select(*keys, last(end("__l", "__le"), ["video_id"], [F.col("__span")], -1).alias("__prior"), last(end("__f", "__fe"), ["video_id"], [F.desc("__span")], -1).alias("__next"))

    met = local.join(spread(beside, *keys, n=n), keys).select("video_id", F.col("__t").alias("ts_ms"), F.coalesce("__up", "__prior").alias("before"), F.coalesce("__down", "__next").alias("after"))
    off = lambda c: F.abs(F.col(f"{c}.start_ms") - F.col("ts_ms"))
    best = F.when(F.col("after").isNull() | (off("before") <= off("after")), F.col("before")).otherwise(F.col("after"))
    found = met.withColumn("s", best).where("s is not null")
    return found.select("video_id", F.col("ts_ms").cast(frames.schema["ts_ms"].dataType).alias("ts_ms"), F.col("s.start_ms").cast(segments.schema["start_ms"].dataType).alias("start_ms"), "s.end_ms", off("s").alias("off"))


def overlaps(scenes_: DataFrame, segments: DataFrame, *, span_ms: int = 60_000) -> DataFrame:
    """Pairs of scenes and segments of a video that meet; segments keep their columns, bounds as seg_start and seg_end.

    Both lie in the stretches of ``span_ms`` that they touch and meet there; a pair
    counts in the stretch where the later of the two begins.
    """
    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / span_ms)
        return df.withColumn("__span", F.explode(F.sequence(at(start), F.greatest(at(start), at(end)))))

    other = segments.withColumnsRenamed({"start_ms": "seg_start", "end_ms": "seg_end"})
    met = dealt(scenes_, "start_ms", "end_ms").join(dealt(other, "seg_start", "seg_end"), ["video_id", "__span"])
    return met.where("seg_start < end_ms and seg_end > start_ms").where(F.col("__span") == F.floor(F.greatest("start_ms", "seg_start") / span_ms)).drop("__span")


def searched(segments: DataFrame, *, text: str | None = None, label: str | None = None, person: str | None = None, obj: str | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Segments with ``score``: 0.1 for the range (ends included), 0.4 for text, 0.3 for a label, 0.5 for a person, 0.4 for an object; those without any go."""
    zero, parts = F.lit(0.0), []
    if between is not None:
        meets = (F.col("start_ms") <= between[1]) & (F.col("end_ms") >= between[0])
        segments = segments.where(meets)
        parts.append(F.lit(0.1))
    if text:
        parts.append(F.when(F.contains(F.lower("ocr_text"), F.lit(text.lower())), 0.4).otherwise(zero))
    if label:
        parts.append(F.when(F.exists("labels", lambda x: F.contains(F.lower(x), F.lit(label.lower()))), 0.3).otherwise(zero))
    if person:
        parts.append(F.when(F.array_contains("people", person), 0.5).otherwise(zero))
    if obj:
        parts.append(F.when(F.exists("labels", lambda x: F.lower(x) == obj.lower()), 0.4).otherwise(zero))
    return segments.withColumn("score", sum(parts, zero)).where("score > 0")


def highlights(scenes_: DataFrame, segments: DataFrame, videos: DataFrame, *, least: float = 0.4) -> DataFrame:
    """``video_id, start_ms, end_ms, score, reasons`` of scenes worth showing.

    Scenes have video_id, start_ms, end_ms, confidence; segments also people,
    labels and ocr_text; videos video_id and duration_ms. 0.1 for each segment with
    people (0.3 at most), 0.04 for each label (0.2 at most), 0.1 for text, 0.1 for a
    scene shorter than 0.7 of the mean segment's share of the video, a tenth of the
    scene's confidence. A scene that meets no segment can't reach ``least``.
    """
    share = segments.groupBy("video_id").agg(F.count("*").alias("__n")).join(videos.select("video_id", "duration_ms"), "video_id").select("video_id", (F.col("duration_ms") / F.greatest(F.lit(1), F.col("__n"))).alias("__mean"))
    met = overlaps(scenes_.withColumnRenamed("confidence", "__sure"), segments)
    by = met.groupBy("video_id", "start_ms", "end_ms", "__sure").agg(
        F.count_if(F.coalesce(F.size("people"), F.lit(0)) > 0).alias("people"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.max(F.coalesce(F.length("ocr_text") > 0, F.lit(False))).alias("text"),
    )
    score = (
        F.least(F.lit(0.3), F.col("people") * 0.1) + F.least(F.lit(0.2), F.size("labels") * 0.04) + F.when(F.col("text"), 0.1).otherwise(0.0)
        + F.when(F.col("end_ms") - F.col("start_ms") < F.col("__mean") * 0.7, 0.1).otherwise(0.0) + F.col("__sure") * 0.1
    )
    said = F.array_compact(F.array(
        F.when(F.col("people") > 0, F.concat(F.col("people").cast("string"), F.lit(" people detected"))),
        F.when(F.size("labels") > 0, F.concat(F.lit("Objects: "), F.array_join(F.slice("labels", 1, 3), ", "))), F.when(F.col("text"), "Text detected on screen"),
    ))
    scored = by.join(share, "video_id").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).where(F.col("score") >= least)
    return scored.select("video_id", "start_ms", "end_ms", "score", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("Visual content"))).alias("reasons"))


def summaries(scenes_: DataFrame, segments: DataFrame, highlights_: DataFrame, videos: DataFrame) -> DataFrame:
    """``video_id, duration_ms, n_scenes, n_people, n_labels, n_texts, n_highlights``: what was found in each video, each thing once."""
    def each(column: Column, name: str) -> DataFrame:
        found = segments.select("video_id", column.alias("x")).where("x is not null and x <> ''").distinct()
        return found.groupBy("video_id").agg(F.count("*").alias(name))

    parts = [
        scenes_.groupBy("video_id").agg(F.count("*").alias("n_scenes")), each(F.explode("people"), "n_people"), each(F.explode("labels"), "n_labels"), each(F.col("ocr_text"), "n_texts"),
        highlights_.groupBy("video_id").agg(F.count("*").alias("n_highlights")),
    ]
    out = videos.select("video_id", "duration_ms")
    for part in parts:
        out = out.join(part, "video_id", "left")
    return out.fillna(0, ["n_scenes", "n_people", "n_labels", "n_texts", "n_highlights"])


def chapters(scenes_: DataFrame, segments: DataFrame) -> DataFrame:
    """Each scene with the people and labels of the segments it meets, sorted."""
    met = overlaps(scenes_, segments)
    return met.groupBy("video_id", "start_ms", "end_ms").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


def chapter_titles(scenes_: DataFrame, segments: DataFrame) -> DataFrame:
    """``video_id, start_ms, end_ms, title``: a scene's label, or two of what its segments show, or its time."""
    first = F.array_sort(F.collect_list(F.struct("seg_start", "seg_end", F.concat(F.when(F.coalesce(F.size("people"), F.lit(0)) > 0, F.array(F.lit("People"))).otherwise(F.array().cast("array<string>")), F.slice("labels", 1, 2)).alias("shown"))))
    met = overlaps(scenes_, segments).groupBy("video_id", "start_ms", "end_ms").agg(F.array_distinct(F.flatten(F.transform(first, lambda x: x["shown"]))).alias("shown"))
    named = scenes_.join(met, ["video_id", "start_ms", "end_ms"], "left")
    title = F.when(F.length("label") > 0, F.col("label")).when(F.size("shown") > 0, F.array_join(F.slice("shown", 1, 2), " & ")).otherwise(F.concat(F.lit("Scene "), clock(F.col("start_ms"))))
    return named.select("video_id", "start_ms", "end_ms", title.alias("title"))


def evenness(frames: DataFrame) -> DataFrame:
    """``video_id, evenness``: 1 less half the variation of the gaps between frames, within 0 and 1; 0.5 with fewer than two frames, or all at one time."""
    w = Window.partitionBy("video_id").orderBy("ts_ms")
    gaps = frames.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(w))
    even = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop("gap") / F.avg("gap") / 2))
    return gaps.groupBy("video_id").agg(F.when(F.coalesce(F.avg("gap"), F.lit(0.0)) == 0, 0.5).otherwise(even).alias("evenness"))


def quality(frames: DataFrame) -> DataFrame:
    """``video_id, score, issues``: 0.4 of 1 - mean blur, 0.4 mean quality, 0.2 evenness; means of nothing count half. Frames have ts_ms, blur, quality."""
    by = frames.groupBy("video_id").agg(F.coalesce(F.avg("blur"), F.lit(0.5)).alias("blur"), F.coalesce(F.avg("quality"), F.lit(0.5)).alias("quality"), F.count("*").alias("n")).join(evenness(frames), "video_id")
    issues = F.array_compact(F.array(F.when(F.col("blur") > 0.7, "blurry"), F.when(F.col("quality") < 0.3, "low_quality"), F.when(F.col("n") < 3, "few_frames"), F.when(F.col("evenness") < 0.3, "uneven")))
    return by.select("video_id", unit_range(0.4 * unit_range(1 - F.col("blur")) + 0.4 * F.col("quality") + 0.2 * F.col("evenness")).alias("score"), issues.alias("issues"))


def representative(frames: DataFrame) -> DataFrame:
    """The frames marked ``representative``, as (``video_id, rank, ts_ms``) in order of time."""
    w = Window.partitionBy("video_id").orderBy("ts_ms")
    return frames.where("representative").select("video_id", F.row_number().over(w).alias("rank"), "ts_ms")


def work_list(states: DataFrame, statuses: Sequence[int]) -> DataFrame:
    return states.where(F.col("status").isin(list(statuses)))


def unit_range(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def storage(frames: DataFrame) -> DataFrame:
    """``video_id, n, bytes`` of stored frames, and the share of all bytes."""
    by = frames.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    total = by.agg(F.sum("bytes").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("video_id", "n", "bytes", F.coalesce(F.try_divide("bytes", "total"), F.lit(0.0)).alias("share"))  # one row


def running_mean(old: Column, old_n: Column, new: Column) -> Column:
    """A mean vector after one more; vectors of another size leave it as it is."""
    joined = F.zip_with(old, new, lambda a, b: (a * old_n + b) / (old_n + 1))
    return F.when(F.size(old) == F.size(new), joined).otherwise(old)


def ocr_summary(rows: DataFrame) -> DataFrame:
    """``media_id, text, confidence, left, top, width, height``: lines joined in reading order, mean confidence, the box around all."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"])
    by = rows.groupBy("media_id").agg(
        F.array_join(lines, "\n").alias("text"), F.avg("confidence").alias("confidence"),
        F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"),
    )
    return by.select("media_id", "text", unit_range(F.col("confidence")).alias("confidence"), F.col("l").alias("left"), F.col("t").alias("top"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"))
