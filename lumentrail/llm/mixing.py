"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources at once. They are summed by membership
pattern; a flow routes each pattern's words to the quotas of its sources, where a
second and third use of the same words cost more (convex repetition costs); the
flow of a pattern is then cut into whole passes over its documents and a seeded
part. A source that shares no document with another needs no graph: its one
pattern gets its quota.

The driver holds one row per pattern and per source (as arrays), never one per
document; a plan of more than ``BROADCAST_PATTERNS`` patterns is joined by a
shuffle. The seeded part is found from sums over prefixes of a document's hash,
so no task sorts the documents of a source.

Defined cases: a null or empty text has no words; a null source is a source of
its own, last in order; a document without sources is never taken; rows that
repeat an id count each, draw alike and are ordered by size; a text of any length
is counted whole; other columns are not looked at; an empty table gives an empty
mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.llm.common import WORD, settle

#: Cost of the first, second and third use of a word.
REPETITION_COSTS = (0, 1, 3)
#: Plans of up to so many patterns (about 100 bytes each) are broadcast.
BROADCAST_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 3.0) -> list[float]:
    """Quotas by weight of ``total``, none above ``most`` times its source's size; what a full source leaves goes to the others by weight."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_, left = np.zeros(len(size)), np.ones(len(size), bool), float(total)
    while open_.any():
        unit = left / math.fsum(weight[open_])
        full = open_ & (unit * weight > most * size)
        if not full.any():
            out[open_] = unit * weight[open_]
            break
        out[full] = most * size[full]
        left, open_ = max(0.0, left - math.fsum(most * size[full])), open_ & ~full
    return out.tolist()


def min_cost_flow(supplies: Sequence[int], quotas: Sequence[int], edges: Sequence[tuple[int, int]], costs: Sequence[int] = REPETITION_COSTS) -> dict[tuple[int, int], int]:
    """Words routed along each (pattern, source) edge.

    A pattern offers its supply once at each cost. As only these offers cost
    anything, the cheapest largest flow comes cost by cost: the largest flow over
    the cheapest offers, then paths for what the next ones add (a path may route
    words anew but never takes an offer back). Each step is a blocking flow on
    shortest paths.
    """
    n_p, n_s = len(supplies), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, capacity: int) -> int:
        for x, y, r in ((a, b, capacity), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    offers = [link(start, p, 0) for p in range(n_p)]
    routes = {(p, s): link(p, n_p + s, sum(quotas) + 1) for p, s in edges}
    for s, quota in enumerate(quotas):
        link(n_p + s, end, quota)

    def reached() -> list[int]:
        far, queue = [-1] * len(graph), [start]
        far[start] = 0
        for x in queue:
            for e in graph[x]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[x] + 1
                    queue.append(to[e])
        return far

    for _ in sorted(costs):
        for offer, words in zip(offers, supplies):
            room[offer] += words
        while (far := reached())[end] >= 0:
            at, path, x = [0] * len(graph), [], start
            while True:
                if x == end:
                    step = min(room[e] for e in path)
                    for e in path:
                        room[e] -= step
                        room[e ^ 1] += step
                    path, x = [], start
                elif at[x] < len(graph[x]):
                    e = graph[x][at[x]]
                    if room[e] and far[to[e]] == far[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        at[x] += 1
                elif x == start:
                    break
                else:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
    return {k: room[e + 1] for k, e in routes.items()}


def routed(patterns: Sequence[Sequence], sizes: Sequence[int], quotas: dict, most: int) -> list[int]:
    """Words that the mix takes of each pattern, ``quotas`` being whole words by source."""
    shared = {s for p in patterns if len(p) > 1 for s in p}
    out = [min(quotas[p[0]], most * n) if len(p) == 1 and p[0] not in shared else 0 for p, n in zip(patterns, sizes)]
    meet = [i for i, p in enumerate(patterns) if any(s in shared for s in p)]
    at = {s: k for k, s in enumerate(sorted(shared, key=lambda s: (s is None, s or "")))}
    flow = min_cost_flow([sizes[i] for i in meet], [quotas[s] for s in at], [(k, at[s]) for k, i in enumerate(meet) for s in patterns[i]], REPETITION_COSTS[:most])
    for (k, _), words in flow.items():
        out[meet[k]] += words
    return out


def mix_sources(
    docs: DataFrame,
    members: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document with ``doc_id, size, source_size, target, taken``.

    ``members`` is the array of a document's sources. ``source_size`` and
    ``target`` are sums over those sources. ``taken`` counts the words the mix
    takes, repeats included: whole passes, and for documents before the seeded
    cut one more; the document at the cut gives only the words still missing.
    """
    pattern = F.array_sort(F.array_distinct(members))
    # Rows without an id are drawn by their text, so that they are not all one.
    drawn = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sized = settle(
        docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), pattern.alias("pattern"), F.md5(F.concat(F.lit(seed), drawn)).alias("draw"))
        .withColumn("pkey", F.to_json("pattern"))
    )
    rows = sized.groupBy("pkey").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).toArrow().sort_by("pkey")
    keys, patterns, sizes = (rows.column(c).to_pylist() for c in ("pkey", "pattern", "size"))
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    source_sizes = dict.fromkeys(names, 0)
    for p, n in zip(patterns, sizes):
        for s in p:
            source_sizes[s] += n
    quotas = dict(zip(names, targets(list(source_sizes.values()), [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)))
    taken = routed(patterns, sizes, {s: round(q) for s, q in quotas.items()}, int(most))
    whole = [divmod(t, n) if n else (0, 0) for t, n in zip(taken, sizes)]
    columns = {
        "pkey": pa.array(keys, pa.string()), "p": pa.array(range(len(keys)), pa.int64()), "passes": pa.array([w for w, _ in whole], pa.int64()), "part": pa.array([w for _, w in whole], pa.int64()),
        "source_size": pa.array([sum(source_sizes[s] for s in p) for p in patterns], pa.int64()), "target": pa.array([float(sum(quotas[s] for s in p)) for p in patterns], pa.float64()),
    }
    spark = docs.sparkSession
    few = len(keys) <= BROADCAST_PATTERNS
    bounded = F.broadcast if few else lambda df: df
    plan = bounded(spark.createDataFrame(pa.table(columns)) if keys else spark.createDataFrame([], "pkey string, p long, passes long, part long, source_size long, target double"))
    planned = sized.join(plan, "pkey")

    # The seeded cut of each pattern: the prefix of the draw in which its part ends, found three hex digits at a time.
    cut, parts = None, planned
    for digits in (3, 6):
        prefix = F.substring("draw", 1, digits)
        if cut is not None:
            parts = planned.join(bounded(cut.select("p", "before", F.col("cell").alias("outer"))), "p").where(F.substring("draw", 1, 3) == F.col("outer"))
        else:
            parts = planned.withColumn("before", F.lit(0).cast("long"))
        sums = parts.groupBy("p", "part", "before", prefix.alias("cell")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("p").orderBy("cell"))
        cut = settle(sums.withColumn("upto", upto).where((F.col("upto") > F.col("part")) & (F.col("upto") - F.col("words") <= F.col("part"))).select("p", "cell", (F.col("upto") - F.col("words")).alias("before")))
    met = planned.join(bounded(cut), "p", "left")  # one row per pattern
    cell = F.substring("draw", 1, 6)
    inside = met.where(cell == F.col("cell"))
    order = Window.partitionBy("p").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    outside = met.where(F.col("cell").isNull() | (cell != F.col("cell"))).withColumn("extra", F.when(cell < F.col("cell"), F.col("size")).otherwise(0).cast("long"))
    both = outside.unionByName(inside)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes") + F.col("extra")).alias("taken"))
