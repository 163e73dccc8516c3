"""Memories and automatic albums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.functions.text import split_list
from lumentrail.functions.time import season, whole_days
from lumentrail.operators.clusters import mean_cosine
from lumentrail.operators.lineage import settle
from lumentrail.operators.stats import best_mean


def temporal_score(n: Column, start: Column, end: Column) -> Column:
    """0.6 of density (2 to 20 items an hour are best) and 0.4 of span (a day or less, then 2 to 7 days, longer, two days at most)."""
    density = n / F.greatest(F.floor(F.timestamp_diff("MINUTE", start, end)) / 60.0, F.lit(1.0))
    days = whole_days(start, end)
    dense = F.when(density.between(2.0, 20.0), 1.0).when(density < 2.0, density / 2.0).otherwise(1.0 - (density - 20.0) / 80.0)
    span = F.when(days == 0, 1.0).when(days.between(2, 7), 0.9).when(days > 7, 0.7).otherwise(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * dense + 0.4 * span))


def place_score(n: Column, located: Column, spread: Column) -> Column:
    """By how far positions spread where more than half of the items have one; else the share of those that do (0.3 where none does)."""
    near = F.when(spread < 0.01, 1.0).when(spread < 0.05, 0.9).when(spread < 0.1, 0.8).otherwise(0.7)
    return F.when(located == 0, 0.3).when(located / n > 0.5, near).otherwise(located / n)


def people_score(share: Column) -> Column:
    """By the share of items with people on them."""
    return F.when(share >= 0.5, 1.0).when(share >= 0.2, 0.8).when(share > 0, 0.6).otherwise(0.3)


def memory_scores(rows: DataFrame, keys: list[str], *, vectors: DataFrame | None = None, least: float = 0.3) -> DataFrame:
    """Clusters (``keys``) with ``score``: 0.25 temporal, 0.20 place, 0.20 people, 0.20 semantic, 0.15 quality; those under ``least`` go.

    Rows have media_id, created, lat, lng, has_people and quality; ``vectors``
    media_id and vector. Semantic is the mean cosine of a cluster's pairs (0.5
    without two vectors), quality the mean of the best 70 % that is known (0.5 if
    nothing is).
    """
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    lat, lng = F.when(located, F.col("lat")), F.when(located, F.col("lng"))
    by = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("created").alias("start"), F.max("created").alias("end"), F.count_if(located).alias("located"),
        F.greatest(F.max(lat) - F.min(lat), F.max(lng) - F.min(lng)).alias("spread"), F.avg(F.coalesce("has_people", F.lit(False)).cast("double")).alias("people"),
        best_mean(F.collect_list("quality")).alias("quality"),
    )
    if vectors is None:
        by = by.withColumn("semantic", F.lit(0.5))
    else:
        found = mean_cosine(rows.select(*keys, "media_id").join(vectors.select("media_id", "vector"), "media_id"), keys)
        by = by.join(found, list(keys), "left").withColumn("semantic", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))), F.lit(0.5))).drop("similarity", "vectors")
    score = (
        0.25 * temporal_score(F.col("n"), F.col("start"), F.col("end")) + 0.2 * place_score(F.col("n"), F.col("located"), F.col("spread"))
        + 0.2 * people_score(F.col("people")) + 0.2 * F.col("semantic") + 0.15 * F.coalesce("quality", F.lit(0.5))
    )
    return by.withColumn("score", score).where(F.col("score") >= least)


def theme(memory: DataFrame) -> Column:
    """trip, people, event, seasonal or everyday, of memories with start, end, n, people (array of names) and place."""
    several = F.to_date("start") != F.to_date("end")
    named = F.coalesce(F.size("people"), F.lit(0))
    placed = F.col("place").isNotNull()
    return (
        F.when(several & placed, "trip").when((named >= 2) | ((named == 1) & (F.col("n") >= 5)), "people")
        .when(placed & (F.col("n") >= 5), "event").when(whole_days(F.col("start"), F.col("end")) > 30, "seasonal").otherwise("everyday")
    )


def titled(memories: DataFrame, now: Column) -> DataFrame:
    """Memories (start, end, n, people, place) with ``theme``, ``title`` and ``subtitle``: what it is, where, when, and the year where it is another."""
    rows = memories.withColumn("theme", theme(memories))
    what = F.when(F.col("theme") == "trip", "Trip").when(F.col("theme") == "event", "Event").when(F.col("theme") == "seasonal", season(F.col("start"))).when(F.col("theme") == "people", F.get("people", F.lit(0)))
    day = lambda t: F.date_format(t, "MMMM d")
    when = (
        F.when(F.to_date("start") == F.to_date("end"), F.date_format("start", "EEEE, MMMM d"))
        .when(F.month("start") == F.month("end"), F.concat(day("start"), F.lit("–"), F.date_format("end", "d")))
        .otherwise(F.concat(day("start"), F.lit(" – "), day("end")))
    )
    year = F.when(F.year("start") != F.year(now), F.year("start").cast("string"))
    title = F.concat_ws(" ", what, F.concat(F.lit("in "), F.col("place")), when, year)
    return rows.withColumn("title", title).withColumn("subtitle", F.when(F.col("n") > 10, F.concat(F.col("n").cast("string"), F.lit(" photos"))))


def completed(memories: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Memories (memory_id, n, start, end, score, people, place) with theme, title, subtitle, ``cover`` and ``persons``.

    ``members``: memory_id, media_id, cover_score, person_id. The cover is the item of
    the best score, ties to the smaller id; people are those of any item, each once.
    """
    by = members.groupBy("memory_id").agg(F.max_by("media_id", F.struct("cover_score", -F.col("media_id"))).alias("cover"))
    seen = members.where("person_id is not null").select("memory_id", "person_id").distinct()
    people = seen.groupBy("memory_id").agg(F.array_sort(F.collect_list("person_id")).alias("persons"))
    return titled(memories, now).join(by, "memory_id", "left").join(people, "memory_id", "left").withColumn("persons", F.coalesce("persons", F.array().cast(people.schema["persons"].dataType)))


def album_title(category: Column, name: Column, trip: Column) -> Column:
    """What an album of :func:`albums` is called; a trip as its memory (``trip``)."""
    month = F.date_format(F.try_to_timestamp(F.concat(name, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMMM yyyy")
    return (
        F.when(category == "best_of_year", F.concat(F.lit("Best of "), name)).when(category == "month", F.concat(month, F.lit(" Highlights")))
        .when(category == "trip", trip).when(category == "person", F.concat(F.lit("Photos with "), name)).otherwise(name)
    )


def captions(media: DataFrame, tags: DataFrame, faces: DataFrame) -> DataFrame:
    """``media_id, caption``: scenes and activities, sure labels, people, camera and place, whatever is known of each.

    ``media``: scenes, activities (comma-joined), is_screenshot, is_document, camera,
    aperture, iso, lat, lng. Labels are in their order as words.
    """
    sure = tags.where(F.col("confidence") > 0.5).select("media_id", "label").distinct().groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))
    seen = faces.groupBy("media_id").agg(F.count("*").alias("faces"), F.count("person_id").alias("persons"))
    listed = lambda c, name: F.when(F.size(split_list(F.col(c))) > 0, F.concat(F.lit(f"{name}: "), F.array_join(split_list(F.col(c)), ", "), F.lit(".")))
    persons = F.when(F.col("persons") == 1, "1 person detected.").when(F.col("persons") > 1, F.concat(F.col("persons").cast("string"), F.lit(" people detected."))).when(F.col("faces") > 1, F.concat(F.col("faces").cast("string"), F.lit(" faces detected.")))
    details = F.concat_ws(", ", F.concat(F.lit("at f/"), F.col("aperture").cast("string")), F.concat(F.lit("ISO "), F.col("iso").cast("string")))
    camera = F.when(F.col("camera") != "", F.concat(F.concat_ws(" ", F.concat(F.lit("Taken with "), F.col("camera")), F.when(details != "", details)), F.lit(".")))
    place = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.format_string("Location: %.4f, %.4f.", "lat", "lng"))
    parts = [
        listed("scenes", "Scene"), listed("activities", "Activity"), F.when(F.col("is_screenshot"), "Screenshot."), F.when(F.col("is_document"), "Document."),
        F.when(F.col("labels").isNotNull(), F.concat(F.lit("Contains: "), F.col("labels"), F.lit("."))), persons, camera, place,
    ]
    text = F.concat_ws(" ", *parts)
    rows = media.join(sure, "media_id", "left").join(seen, "media_id", "left")
    return rows.select("media_id", F.when(text != "", text).otherwise(F.concat(F.lit("Photo "), F.col("media_id").cast("string"))).alias("caption"))


def unseen(candidates: DataFrame, members: DataFrame, *, most_shared: float = 0.7) -> DataFrame:
    """Candidates (``id, score``) most of whose members (``id, media_id``) belong to no better one."""
    ranked = candidates.select("id", F.struct(-F.col("score"), F.col("id")).alias("order"))
    placed = members.join(ranked, "id")
    first = placed.groupBy("media_id").agg(F.min("order").alias("first"))
    seen = placed.join(first, "media_id").groupBy("id").agg(F.avg((F.col("first") < F.col("order")).cast("double")).alias("shared"))
    return candidates.join(seen.where(F.col("shared") <= most_shared).select("id"), "id", "left_semi")


def albums(memories: DataFrame, members: DataFrame, people: DataFrame, now: Column, *, most: int = 100) -> DataFrame:
    """Albums from memories: ``category, name, n, score, start, cover``.

    ``memories``: memory_id, start, score, theme, and maybe ``active`` (those that are
    not make no albums); ``members``: memory_id, position, media_id; ``people``: memory_id, person_id. Best of each year but this one (10
    items), months but this one (5) and seasons (15) take at most ``most`` items,
    memories by falling score (seasons: in their order); trips (5) and people (10
    different items) take all.
    """
    known = memories.where("active") if "active" in memories.columns else memories
    rows = settle(known.join(members, "memory_id"))  # every kind of album reads it
    year, month = F.year("start"), F.date_format("start", "yyyy-MM")
    best, in_order = [F.desc("score"), F.col("memory_id"), F.col("position")], [F.col("memory_id"), F.col("position")]
    kinds: list[tuple[str, DataFrame, Column, Sequence[Column], int]] = [
        ("best_of_year", rows.where(year != F.year(now)), year.cast("string"), best, 10),
        ("month", rows.where(month != F.date_format(now, "yyyy-MM")), month, best, 5),
        ("season", rows, F.concat_ws(" ", season(F.col("start")), year), in_order, 15),
    ]
    out = []
    for category, part, name, order, least in kinds:
        named = part.withColumn("name", name)
        first = named.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("at") <= most)
        # The best score and the first start are of all the memories of a name, also of those whose items found no room.
        whole = named.groupBy("name").agg(F.max("score").alias("score"), F.min("start").alias("start"))
        found = first.groupBy("name").agg(F.count("*").alias("n"), F.min_by("media_id", "at").alias("cover")).where(F.col("n") >= least).join(whole, "name")
        out.append(found.select(F.lit(category).alias("category"), "name", "n", "score", "start", "cover"))
    trips = rows.where("theme = 'trip'").groupBy("memory_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("start").alias("start"), F.min_by("media_id", "position").alias("cover"))
    out.append(trips.where("n >= 5").select(F.lit("trip").alias("category"), F.col("memory_id").cast("string").alias("name"), "n", "score", "start", "cover"))
    once = rows.join(people, "memory_id").groupBy("person_id", "media_id").agg(F.min("start").alias("start"), F.min(F.struct("memory_id", "position")).alias("at"))
    persons = once.groupBy("person_id").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min_by("media_id", "at").alias("cover")).where("n >= 10")
    out.append(persons.select(F.lit("person").alias("category"), F.col("person_id").cast("string").alias("name"), "n", F.lit(0.5).alias("score"), "start", "cover"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found
