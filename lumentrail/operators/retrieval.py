"""Vector, text and hybrid search, and ranking by several signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.functions.geo import haversine_km
from lumentrail.functions.text import jaccard, token_overlap
from lumentrail.functions.time import recency
from lumentrail.functions.vector import cosine, literal

#: Weights of semantic, favorite, recency, quality, usage, album and object signals by intent.
WEIGHTS = {
    "default": (0.50, 0.15, 0.10, 0.08, 0.07, 0.05, 0.05),
    "object": (0.65, 0.0, 0.0, 0.0, 0.0, 0.0, 0.35),
    "person": (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "scene": (0.65, 0.12, 0.08, 0.07, 0.05, 0.03, 0.0),
    "location": (0.35, 0.10, 0.15, 0.05, 0.05, 0.10, 0.20),
}


def vector_scores(vectors: DataFrame, query: Sequence[float] | Column, *, region_tokens: Sequence[str] = (), boost: float = 0.05) -> DataFrame:
    """``media_id, semantic, region``: the best vector of each item. A region whose label the query names gets a boost, within 0 and 1."""
    q = query if isinstance(query, Column) else literal(query)
    score = cosine(F.col("vector"), q)
    if region_tokens:
        named = F.coalesce(F.lower(F.col("region").cast("string")).isin([t.lower() for t in region_tokens]), F.lit(False))
        score = F.when(named, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + boost))).otherwise(score)
    best = F.max(F.struct(score.alias("semantic"), F.col("region").alias("region")))
    return vectors.groupBy("media_id").agg(best.alias("b")).select("media_id", "b.semantic", "b.region")


def text_scores(texts: DataFrame, query: str, *, phrase: bool = False) -> DataFrame:
    """``media_id, text_score``: share of the query's tokens found; rows without any (``phrase``: without the whole query) go."""
    tokens = query.lower().split()
    score = token_overlap(F.col("text"), tokens)
    hit = F.contains(F.lower("text"), F.lit(query.lower())) if phrase else score > 0
    return texts.where(hit).groupBy("media_id").agg(F.max(score).alias("text_score"))


def hybrid(semantic: DataFrame | None, text: DataFrame, media: DataFrame) -> DataFrame:
    """``media_id, semantic, text_score, score`` of items in the catalog; without vectors text alone counts."""
    if semantic is None:
        both = text.select("media_id", F.lit(0.0).alias("semantic"), "text_score")
    else:
        both = semantic.join(text, "media_id", "full_outer").select("media_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("text_score", F.lit(0.0)).alias("text_score"))
    scored = both.withColumn("score", 0.7 * F.col("semantic") + 0.3 * F.col("text_score"))
    return scored.join(media.select("media_id"), "media_id", "left_semi")


def signals(df: DataFrame) -> DataFrame:
    """Adds ``matched``: which signals a row of semantic, text_score, object_score and region has."""
    names = F.array(
        F.when(F.col("text_score") > 0, "ocr"), F.when(F.col("semantic") >= 0.25, "semantic"), F.when(F.col("object_score") > 0, "object"), F.when(F.col("region").isNotNull(), F.concat(F.lit("region:"), F.col("region").cast("string")))
    )
    return df.withColumn("matched", F.array_compact(names))


def ranked(df: DataFrame, *, intent: str = "default", now: Column, album: str | None = None) -> DataFrame:
    """Adds ``rank_score`` to rows of semantic, favorite, created, quality, views, album and object_score."""
    w = WEIGHTS.get(intent, WEIGHTS["default"])
    in_album = F.lit(0.5) if album is None else F.when(F.col("album") == album, 1.0).otherwise(0.0)
    parts = (
        F.col("semantic"),
        F.col("favorite").cast("double"),
        F.coalesce(recency(F.col("created"), now), F.lit(0.0)),
        F.coalesce("quality", F.lit(0.5)),
        F.least(F.lit(1.0), F.log1p(F.col("views").cast("double")) / F.log(F.lit(101.0))),
        in_album,
        F.col("object_score"),
    )
    total = sum((F.lit(x) * part for x, part in zip(w, parts) if x), F.lit(0.0))
    return df.withColumn("rank_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def top(df: DataFrame, k: int, score: str = "score", key: str = "media_id") -> DataFrame:
    """The k best by score, ties to the smaller key."""
    return df.orderBy(F.desc(score), key).limit(k)


def two_phase(scores: DataFrame, details: DataFrame, k: int, *, now: Column, intent: str = "default", over: int = 3) -> DataFrame:
    """Details are fetched for the ``over * k`` best scores only, then ranked and cut to k."""
    rough = top(scores, over * k)
    return top(ranked(rough.join(details, "media_id"), intent=intent, now=now), k, "rank_score")


def person_search(media: DataFrame, faces: DataFrame, person, semantic: DataFrame | None = None) -> DataFrame:
    """Items of one person: 1.0 each, or by semantic score (0.5 where there is none)."""
    own = media.select("media_id").join(faces.where(F.col("person_id") == person).select("media_id"), "media_id", "left_semi")
    if semantic is None:
        return own.withColumn("score", F.lit(1.0))
    return own.join(semantic, "media_id", "left").select("media_id", F.coalesce("semantic", F.lit(0.5)).alias("score"))


def location_search(media: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Items with a position: a base of 0.5, blended with a semantic score."""
    placed = media.where("lat is not null and lng is not null").select("media_id")
    if semantic is None:
        return placed.withColumn("score", F.lit(0.5))
    return placed.join(semantic, "media_id", "left").select("media_id", (0.3 * F.lit(0.5) + 0.7 * F.coalesce("semantic", F.lit(0.0))).alias("score"))


def similar_to(vectors: DataFrame, media_id, k: int) -> DataFrame:
    """Items most similar to one, itself left out. The one vector is a single row, broadcast."""
    own = vectors.where(F.col("media_id") == media_id).orderBy("region").limit(1).select(F.col("vector").alias("__q"))
    others = vectors.where(F.col("media_id") != media_id).crossJoin(F.broadcast(own))  # one row
    return top(others.groupBy("media_id").agg(F.max(cosine(F.col("vector"), F.col("__q"))).alias("score")), k)


def related(candidates: DataFrame, seed: DataFrame, *, least: float = 0.3) -> DataFrame:
    """Items related to a seed (one row): same event (0.3), shared people (0.25), nearness in space (0.2: full to 1 km, none from 10) and time (0.15: full in the
    hour, falling over a day, then from 0.05 over the week), look-alike hash (0.1: under 10 bits apart, less a 64th for each).

    Both have media_id, event, people (array), lat, lng, created, hi and lo.
    """
    s = F.broadcast(seed.limit(1).select(*[F.col(c).alias(f"s_{c}") for c in ("media_id", "event", "people", "lat", "lng", "created", "hi", "lo")]))
    both = candidates.crossJoin(s).where("media_id <> s_media_id")  # one row
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    geo = F.when(km < 1, 1.0).when(km < 10, 1 - (km - 1) / 9).otherwise(0.0)
    hours = F.abs(F.timestamp_diff("HOUR", F.col("s_created"), F.col("created")))
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("s_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("s_lo")))
    score = (
        0.3 * F.coalesce((F.col("event") == F.col("s_event")).cast("double"), F.lit(0.0))
        + 0.25 * jaccard(F.col("people"), F.col("s_people"))
        + 0.2 * F.coalesce(geo, F.lit(0.0))
        + F.coalesce(F.when(hours < 1, 0.15).when(hours < 24, 0.15 * (1 - hours / 24.0)).when(hours < 168, 0.05 * (1 - (hours - 24) / 144.0)), F.lit(0.0))
        + F.coalesce(F.when(bits < 10, 0.1 * (1 - bits / 64.0)), F.lit(0.0))
    )
    return both.withColumn("score", score).where(F.col("score") >= least).select("media_id", "score")


def explained(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Adds ``reasons``: the signals by falling strength, with a word for each."""
    word = lambda c: F.when(c > 0.8, "strong").when(c > 0.5, "good").when(c > 0.2, "weak").otherwise("slight")
    items = F.array(*[F.struct((-F.col(p)).alias("order"), F.lit(p).alias("signal"), F.col(p).alias("strength"), word(F.col(p)).alias("word")) for p in parts])
    return df.withColumn("reasons", F.transform(F.sort_array(F.filter(items, lambda x: x["strength"] > 0)), lambda x: F.struct(x["signal"], x["strength"], x["word"])))


def logged_queries(history: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    """``query, times, last``: counts brought up to date, the ``most`` most frequent kept."""
    both = history.select("query", "times", "last").unionByName(new.select("query", F.lit(1).cast("long").alias("times"), F.col("at").alias("last")))
    counted = both.groupBy("query").agg(F.sum("times").alias("times"), F.max("last").alias("last"))
    return counted.orderBy(F.desc("times"), F.desc("last"), "query").limit(most)


def suggestions(history: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """Queries that begin with a prefix, most frequent first."""
    return history.where(F.startswith(F.lower("query"), F.lit(prefix.lower()))).orderBy(F.desc("times"), F.desc("last"), "query").limit(k)


def recent_queries(history: DataFrame, k: int = 5) -> DataFrame:
    return history.orderBy(F.desc("last"), "query").limit(k)


def popular_but_not_recent(history: DataFrame, k: int = 5) -> DataFrame:
    """Frequent queries that are not among the recent ones."""
    rest = history.join(recent_queries(history, k).select("query"), "query", "left_anti")
    return rest.orderBy(F.desc("times"), F.desc("last"), "query").limit(k)


def seasonal_queries(history: DataFrame, month: int, k: int = 5) -> DataFrame:
    """Queries most often last asked in a month of the year."""
    return history.where(F.month("last") == month).orderBy(F.desc("times"), F.desc("last"), "query").limit(k)
