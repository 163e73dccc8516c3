"""Clustering that depends on order, and selections from clusters.

Greedy operators run over one group at a time with rows sorted inside, so their
results do not depend on partitioning; groups that may be large go in bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.functions.vector import cosine
from lumentrail.operators.lineage import settle


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """The mean vector of each group, as an aggregate by component: groups of any size are combined before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def mean_states(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """``keys..., n, sums``: what the mean vector of each group is made of. States of parts are merged, kept and merged again."""
    parts = rows.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))


def merged_states(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """States by key of both: as one pass over all rows had made them."""
    keys = [c for c in stored.columns if c not in ("n", "sums")]
    both = stored.unionByName(incoming)
    sizes = both.groupBy(*keys).agg(F.sum("n").alias("n"))
    parts = both.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    sums = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))
    return sizes.join(sums, keys).select(*stored.columns)


def means_of(states: DataFrame) -> DataFrame:
    """The mean vectors of states."""
    return states.withColumn("vector", F.transform("sums", lambda x: x / F.col("n"))).drop("n", "sums")


def coherence(rows: DataFrame, keys: Sequence[str], *, key: str = "media_id") -> DataFrame:
    """``keys..., coherence, representative, diversity`` from cosines to the centroid and, by the sum of unit vectors, between all pairs."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = rows.select(*keys, key, F.transform("vector", lambda x: x.cast("double") / length).alias("vector"))
    centre = mean_vectors(unit, keys).withColumnRenamed("vector", "centre")
    to_centre = F.aggregate(F.zip_with("vector", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    centre_length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    near = unit.join(centre, list(keys)).withColumn("near", to_centre / centre_length)
    by = near.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("near").alias("coherence"), F.max_by(key, F.struct("near", -F.col(key))).alias("representative"), F.first(centre_length).alias("r"))
    # The mean cosine of distinct pairs of unit vectors is (n r^2 - 1) / (n - 1), r being the length of their mean.
    pairs = (F.col("n") * F.col("r") * F.col("r") - 1) / (F.col("n") - 1)
    return by.select(*keys, F.col("coherence"), F.col("representative"), F.when(F.col("n") > 1, 1 - pairs).otherwise(0.0).alias("diversity"))


def mean_cosine(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """``keys..., vectors, similarity``: the mean cosine of each group's pairs, from the sum of its unit vectors; null without a pair.

    Groups of any size are combined before the shuffle. A vector without length has cosine 0 with any other.
    """
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = rows.select(*keys, F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)).alias("unit"), (length > 0).cast("double").alias("square"))
    sums = unit.select(*keys, F.posexplode("unit").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("whole"))
    counts = unit.groupBy(*keys).agg(F.count("*").alias("vectors"), F.sum("square").alias("squares"))
    mean = (F.col("whole") - F.col("squares")) / (F.col("vectors") * (F.col("vectors") - 1))
    return counts.join(whole, list(keys)).select(*keys, "vectors", F.when(F.col("vectors") > 1, mean).alias("similarity"))


def diverse(rows: DataFrame, keys: Sequence[str], k: int, *, key: str = "media_id") -> DataFrame:
    """``keys..., media_id, rank``: best score first, then whatever is least like one of those chosen (ties: better score, smaller id).

    ``k`` rounds over tables; a group of any size is spread over tasks.
    """
    left = settle(rows.select(*keys, key, "score", "vector").withColumn("near", F.lit(1.0)))
    chosen = None
    for rank in range(1, k + 1):
        first = F.struct(*([] if rank == 1 else [(1 - F.col("near")).alias("gain")]), F.col("score"), (-F.col(key)).alias("order"))
        best = settle(left.groupBy(*keys).agg(F.max_by(F.struct(F.col(key).alias("taken"), F.col("vector").alias("other")), first).alias("b")).select(*keys, "b.*"))
        picked = best.select(*keys, F.col("taken").alias(key), F.lit(rank).alias("rank"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if rank < k:
            met = left.join(best, list(keys)).where(F.col(key) != F.col("taken"))
            left = settle(met.withColumn("near", F.least("near", cosine(F.col("vector"), F.col("other")))).drop("taken", "other"))
    return chosen


def sub_themes(rows: DataFrame, keys: Sequence[str], *, key: str = "media_id", least: float = 0.6, least_size: int = 3) -> DataFrame:
    """``keys..., media_id, theme``: within a cluster the first item not yet placed begins a theme, and takes each later one whose mean cosine with its members reaches ``least``.

    Themes under ``least_size`` go; a cluster without any, and one too small for
    two, is one theme (0). An item asks themes in the order in which they began, and
    what it finds there depends on earlier items only; so one pass over a cluster's
    sorted items places all of them. It keeps a sum of unit vectors for each theme,
    with which the mean cosine is a product, and no items: clusters have any size.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, key])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, sizes = None, np.zeros((0, 0)), np.zeros(0)
        for rows in batches:
            place = np.zeros(len(rows), int)
            for i, (vector, *own) in enumerate(zip(rows["vector"], *(rows[c] for c in keys))):
                x = _unit(np.asarray(vector, float)[None])[0]
                if own != now:
                    now, sums, sizes, used = own, np.zeros((16, len(x))), np.ones(16), 0
                fits = np.flatnonzero(sums[:used] @ x / sizes[:used] >= least)
                if len(fits):
                    place[i] = fits[0]
                else:
                    if used == len(sums):
                        sums, sizes = np.vstack([sums, np.zeros_like(sums)]), np.concatenate([sizes, np.ones_like(sizes)])
                    place[i], sizes[used], used = used, 0, used + 1
                sums[place[i]] += x
                sizes[place[i]] += 1
            yield rows[[*keys, key]].assign(place=place)

    keys = list(keys)
    dealt = rows.select(*keys, key, "vector").repartition(*keys).sortWithinPartitions(*keys, key)
    placed = settle(dealt.mapInPandas(run, f"{kinds}, place int"))
    sized = placed.groupBy(*keys, "place").agg(F.count("*").alias("n"))
    total, large = F.sum("n").over(Window.partitionBy(*keys)), (F.col("n") >= least_size)
    several = (total >= 2 * least_size) & (F.max(large).over(Window.partitionBy(*keys)))
    numbered = sized.withColumn("several", several).where(~F.col("several") | large)
    theme = F.when(F.col("several"), F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1).otherwise(0)
    return placed.join(numbered.select(*keys, "place", theme.cast("int").alias("theme")), [*keys, "place"]).select(*keys, key, "theme")


def kept_boxes(boxes: DataFrame, keys: Sequence[str], *, over: float = 0.45, least: float = 0.25, most: int | None = None, key: str = "box_id") -> DataFrame:
    """Non-maximum suppression: boxes by falling confidence, less those that cover a kept one by more than ``over``. Columns: keys, box_id, confidence, left, top, width, height.

    Items are sorted into tasks and gone through in runs, many to a batch.
    """

    def kept(l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, area: np.ndarray) -> list[int]:
        free, out = np.ones(len(l), bool), []
        for i in range(len(l)):
            if free[i] and (most is None or len(out) < most):
                out.append(i)
                w, h = np.minimum(r, r[i]) - np.maximum(l, l[i]), np.minimum(b, b[i]) - np.maximum(t, t[i])
                both = np.clip(w, 0, None) * np.clip(h, 0, None)
                free &= both <= over * (area + area[i] - both)
        return out

    def starts(rows: pd.DataFrame) -> np.ndarray:
        own = rows[list(keys)]
        return np.flatnonzero(np.concatenate([[True], (own.iloc[1:].to_numpy() != own.iloc[:-1].to_numpy()).any(axis=1)]))

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        l, t = rows["left"].to_numpy(), rows["top"].to_numpy()
        r, b = l + rows["width"].to_numpy(), t + rows["height"].to_numpy()
        area, stays = (r - l) * (b - t), []
        first = starts(rows)
        for at, to in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
            stays += [at] if to == at + 1 and most != 0 else [at + i for i in kept(l[at:to], t[at:to], r[at:to], b[at:to], area[at:to])]
        return rows.iloc[stays]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last item so far may go on
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(rows):
                last = int(starts(rows)[-1])
                held = rows.iloc[last:].reset_index(drop=True)
                if last:
                    yield done(rows.iloc[:last])
        if held is not None:
            yield done(held)

    sure = boxes.where(F.col("confidence") >= least).repartition(*keys).sortWithinPartitions(*keys, F.desc("confidence"), key)
    return sure.mapInPandas(run, boxes.schema)


def best_regions(boxes: DataFrame, *, least: float = 0.5, least_area: float = 0.02, most: int = 3) -> DataFrame:
    """The most certain regions of each item that are large enough."""
    w = Window.partitionBy("media_id").orderBy(F.desc("confidence"), "box_id")
    large = boxes.where((F.col("confidence") >= least) & (F.col("width") * F.col("height") >= least_area))
    return large.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def merged_people(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Faces under the person that theirs was merged into (``person_id, into``)."""
    return faces.join(merges, "person_id", "left").withColumn("person_id", F.coalesce("into", "person_id")).drop("into")


def moved_faces(faces: DataFrame, moves: DataFrame, people: DataFrame) -> DataFrame:
    """Faces (``face_id``) under the active person that each was moved to (``face_id, into``; of several the first)."""
    active = people.where("status = 'active'").select(F.col("person_id").alias("into"))
    once = moves.join(active, "into", "left_semi").groupBy("face_id").agg(F.min("into").alias("into"))
    return faces.join(once, "face_id", "left").withColumn("person_id", F.coalesce("into", "person_id")).drop("into")


def deleted_people(faces: DataFrame, people: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces that belong to nobody any more where theirs was deleted (``person_id``; active ones only), and the people with that status."""
    marked = people.where("status = 'active'").select("person_id").join(gone.select("person_id"), "person_id", "left_semi").withColumn("__gone", F.lit(True))
    kept = faces.join(marked, "person_id", "left").withColumn("person_id", F.when(F.col("__gone").isNull(), F.col("person_id"))).drop("__gone")
    return kept, people.join(marked, "person_id", "left").withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).drop("__gone")


def reset_people(faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces without people, and no people."""
    return faces.withColumn("person_id", F.lit(None).cast(faces.schema["person_id"].dataType)), people.limit(0)


def photo_score(quality: Column, blur: Column) -> Column:
    """0.4 quality, 0.3 blur score (higher is sharper), 0.15 for no known time; unknown ones count half; within 0 and 1."""
    total = 0.4 * F.coalesce(quality, F.lit(0.5)) + 0.3 * F.coalesce(blur, F.lit(0.5)) + 0.15
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def well_composed(width: Column, height: Column) -> Column:
    """Landscape (1.3 to 1.8), portrait (0.55 to 0.77) or square (0.9 to 1.1)."""
    ratio = F.try_divide(width.cast("double"), height)
    fits = ratio.between(1.3, 1.8) | ratio.between(0.55, 0.77) | ratio.between(0.9, 1.1)
    return F.coalesce((width != 0) & fits, F.lit(False))


def cover_score(quality: Column, blur: Column, people: Column, width: Column, height: Column) -> Column:
    """The photo's score; less 0.3 unless quality and blur score are over 0.7, more for people (0.15) and format (0.1)."""
    candidate = F.coalesce((quality > 0.7) & (blur > 0.7), F.lit(False))
    return photo_score(quality, blur) - F.when(candidate, 0.0).otherwise(0.3) + F.when(people, 0.15).otherwise(0.0) + F.when(well_composed(width, height), 0.1).otherwise(0.0)


def covers(scored: DataFrame, keys: Sequence[str], *, key: str = "media_id") -> DataFrame:
    """``keys..., cover``: the item of best ``score`` in each group, ties to the smaller id."""
    return scored.groupBy(*keys).agg(F.max_by(key, F.struct("score", -F.col(key))).alias("cover"))
