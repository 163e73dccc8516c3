"""Connected components of an edge table.

Edges are first contracted where they lie: a task reduces the edges of its
partition, of bounded number, to a spanning forest of stars by union-find. Where
all edges fit one task that is the answer. Otherwise the forests go through
alternating large and small stars, each round two shuffles and a settled table.

Nothing but a count reaches the driver. A node of very high degree is one key of
a grouped minimum, which is combined before the shuffle, and its edges are split
by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import settle


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as edges from each node to the smallest one it is joined to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [(x, r) for x, r in pairs if x != r]
    for at in range(0, len(pairs), 50_000):
        u, v = zip(*pairs[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = 1_000_000) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a``, ``b``: long) that another is joined to; ``comp`` is the smallest node reachable.

    Loops and repeated edges do no harm. ``most_rounds`` is a guard: it raises,
    it never returns components that are not final.
    """
    # Each edge from its larger to its smaller end.
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    tasks = max(1, -(-now.count() // task_edges))
    now = settle(now.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
    if tasks == 1:
        return _labels(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node hang on the smallest one near it.
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and those below it hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = settle(small)
        # Final when every node hangs on one other and none of those hangs on a third: all edges are stars.
        roots = after.select("v").distinct()
        open_ = after.join(roots.withColumnRenamed("v", "u"), "u", "left_semi").limit(1).count()
        twice = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        now = after
        if not open_ and not twice:
            return _labels(now)
    raise RuntimeError(f"components not final after {most_rounds} rounds")


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
