"""Exact and near duplicates by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.functions.hashing import hamming
from lumentrail.operators.lineage import settle


def exact_groups(df: DataFrame, content: str = "content_hash", key: str = "media_id") -> DataFrame:
    """``hash, first`` (smallest id), ``n`` of hashes that several items share; counts alone, whatever a group's size."""
    return df.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def exact_members(df: DataFrame, content: str = "content_hash", key: str = "media_id") -> DataFrame:
    """``hash, member``: a row for each item of the groups of :func:`exact_groups`."""
    rows = df.where(F.col(content).isNotNull()).select(F.col(content).alias("hash"), F.col(key).alias("member"))
    return rows.join(exact_groups(df, content, key).select("hash"), "hash", "left_semi")


def hamming_pairs(df: DataFrame, *, key: str = "media_id", within: int = 8) -> DataFrame:
    """Pairs ``a < b`` of 64-bit hashes (``hi``, ``lo``: 32 bits each) at most ``within`` bits apart, with ``bits``; of copies use one (see :func:`near_groups`).

    Exact: in at least one of a few wide bands of bits two such hashes differ by at
    most ``slack`` bits, so one side goes by its bands as they are, the other by
    all bands that near to its own. Bands have 16 bits and more, for which a chance
    meeting is rare.
    """
    slack = 1 if within <= 5 else 2
    bands = within // (slack + 1) + 1
    cuts = [64 * i // bands for i in range(bands + 1)]

    def band(i: int) -> Column:
        """Bits from one cut to the next of the 64 (32 of them at most, unless there is one band), without forming a signed 64-bit number."""
        parts = []
        for half, at in (("hi", 0), ("lo", 32)):
            low, high = max(cuts[i] - at, 0), min(cuts[i + 1] - at, 32)
            if low < high:
                parts.append((F.shiftright(F.col(half), 32 - high).bitwiseAND((1 << (high - low)) - 1), high - low))
        return parts[0][0] if len(parts) == 1 else F.shiftleft(parts[0][0], parts[1][1]).bitwiseOR(parts[1][0])

    def near(i: int) -> Column:
        width = cuts[i + 1] - cuts[i]
        bits = [1 << k for k in range(width)]
        masks = [0, *bits, *(a | b for k, a in enumerate(bits) for b in bits[:k] if slack == 2)]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).alias("i"), band(i).bitwiseXOR(m).alias("x")))

    one = df.select(F.col(key).alias("id"), "hi", "lo", F.explode(F.flatten(F.array(*[near(i) for i in range(bands)]))).alias("band"))
    other = df.select(F.col(key).alias("b"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(i).alias("x")) for i in range(bands)])).alias("band"))
    apart = hamming(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2"))
    return one.join(other, "band").where("id < b").withColumn("bits", apart).where(F.col("bits") <= within).select(F.col("id").alias("a"), "b", "bits").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, comp`` of an edge table (``a``, ``b``); ``comp`` is the smallest node reachable.

    Labels spread from smaller to larger ends and jump along earlier labels, so
    the number of rounds follows the logarithm of a component's width. Each round
    is settled. The guard raises; it never cuts a component short.
    """
    both = settle(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        jumped = labels.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp").select("node", "comp", "root")
        after = settle(jumped.join(near, "node").select("node", F.least("root", "near").alias("comp"), F.col("comp").alias("was")))
        labels = after.select("node", "comp")
        if not after.where("comp <> was").limit(1).count():
            return labels
    raise RuntimeError(f"components not final after {most_rounds} rounds")


def near_groups(df: DataFrame, *, key: str = "media_id", within: int = 8) -> DataFrame:
    """``node, comp``: connected components of items whose hashes are near, by distinct hash."""
    classes = df.groupBy("hi", "lo").agg(F.min(key).alias("id"))
    comps = components(hamming_pairs(classes, key="id", within=within))
    member = df.join(classes, ["hi", "lo"]).select(F.col(key).alias("node"), "id")
    placed = member.join(comps.select(F.col("node").alias("id"), "comp"), "id", "left").select("node", F.coalesce("comp", "id").alias("comp"))
    several = placed.groupBy("comp").count().where("count > 1").select("comp")
    return placed.join(several, "comp", "left_semi")


def group_similarity(df: DataFrame, groups: DataFrame, *, key: str = "media_id") -> DataFrame:
    """``comp, n, similarity``: 1 - mean distance of a group's pairs / 64, from counts of ones per bit and not from pairs."""
    ones = [F.sum(F.shiftright(F.col(h), i).bitwiseAND(1)).alias(f"{h}{i}") for h in ("hi", "lo") for i in range(32)]
    counted = groups.join(df.select(F.col(key).alias("node"), "hi", "lo"), "node").groupBy("comp").agg(F.count("*").alias("n"), *ones)
    apart = sum((F.col(f"{h}{i}") * (F.col("n") - F.col(f"{h}{i}")) for h in ("hi", "lo") for i in range(32)), F.lit(0))
    return counted.select("comp", "n", (1 - apart / (F.col("n") * (F.col("n") - 1) / 2.0) / 64.0).alias("similarity"))


def keep_best(df: DataFrame, groups: DataFrame, *, key: str = "media_id") -> DataFrame:
    """``comp, best``: the member of best quality (null: 0.5), ties to the smaller id."""
    rows = groups.join(df.select(F.col(key).alias("node"), "quality"), "node")
    return rows.groupBy("comp").agg(F.max_by("node", F.struct(F.coalesce("quality", F.lit(0.5)), -F.col("node"))).alias("best"))


def duplicates_of(df: DataFrame, media_id, *, key: str = "media_id", within: int = 8) -> DataFrame:
    """``media_id, bits`` of items within reach of one."""
    own = df.where(F.col(key) == media_id).limit(1).select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    apart = hamming(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2"))
    return df.where(F.col(key) != media_id).crossJoin(F.broadcast(own)).select(F.col(key).alias("media_id"), apart.alias("bits")).where(F.col("bits") <= within)  # one row


def visible_groups(groups: DataFrame, gone: DataFrame) -> DataFrame:
    """Members (``comp, node``) without those that are gone (``media_id``), of the groups that keep two."""
    left = groups.join(gone.select(F.col("media_id").alias("node")), "node", "left_anti")
    several = left.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    return left.join(several, "comp", "left_semi")
