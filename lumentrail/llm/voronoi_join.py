"""Exact top-k inner products by a Voronoi kNN join.

Largest inner products become nearest neighbours with one more component: a
candidate x gets ``sqrt(M - |x|^2)`` (M: the largest squared length), a query 0;
queries are brought to the same length, which changes no ranking and takes them
near the pivots.
Pivots from a bounded sample cut that space into cells. From each cell's summary
(its radii, and its ``k`` members nearest to the pivot) follows, for each cell of
queries, a distance within which every query has its neighbours, and from the
triangle inequality the radii at which another cell can hold one. A candidate is
sent only to the groups of queries that may need it, and there all products are
taken in exact integers.

A group holds a bounded number of queries: a cell with more is several groups. A
group's candidates are split into blocks by a hash. So a vector that a
third of the rows share makes more blocks, not larger ones. Where vectors spread
evenly over many dimensions the bounds exclude little and the join comes down to
blocks of queries against blocks of candidates, which the stated query set allows;
groups and blocks are then as large as a task's memory lets them, so that each
row travels to few of them.

Defined cases: null vectors and those with null or non-finite components take no
part; a zero vector does; vectors of each size are searched among themselves;
rows that repeat an id are rows of their own: each is searched, and is a candidate
of the other; equal products go by the smaller id; products that do not fit
doubles exactly are taken in Python's integers and must fit a long; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.llm.common import settle
from lumentrail.llm.vectors import by_size, k_means, matrix, nearest, sampled, usable


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the component that makes them equally long."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))[:, None]])


def levelled(q: np.ndarray, most: float) -> np.ndarray:
    """Queries as long as the lifted candidates, and no component more; a zero query stays."""
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    return np.hstack([q * (math.sqrt(most) / np.where(length > 0, length, 1)), np.zeros((len(q), 1))])


def radii(x: np.ndarray, pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - pivots[cells]) ** 2).sum(axis=1))


def needed(pivots: np.ndarray, query_radius: dict[int, float], nearest_radii: dict[int, list[float]], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each cell of queries, the smallest and largest radius at which each other cell's members may be needed.

    One more neighbour than ``k`` is allowed for, as one of them may be the query itself.
    """
    apart = np.sqrt(np.maximum(0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))
    slack = 1e-6 * (1 + apart.max())  # what roots of differences of squares lose
    out = {}
    for i, u in query_radius.items():
        reach = sorted(u + apart[i, j] + r for j, rs in nearest_radii.items() for r in rs)
        theta = reach[k] if len(reach) > k else math.inf
        out[i] = (apart[i] - u - theta - slack, apart[i] + u + theta + slack)
    return out


def best_products(q: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> tuple[list, list, list]:
    """Per query (its own row: ``own``) the ``k`` largest products: the query's place, the candidate's, the score. Of equal ones the earlier candidates."""
    out: tuple[list, list, list] = ([], [], [])
    exact = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53
    if not exact:
        q, x = (np.vectorize(int, otypes=[object])(z) for z in (q, x))
    for at in range(0, len(q), 1024):
        kept: list[list] = [[] for _ in range(len(q[at : at + 1024]))]
        for start in range(0, len(x), 4096):
            part = rows[start : start + 4096]
            for row, query_row, best in zip(q[at : at + 1024] @ x[start : start + 4096].T, own[at : at + 1024].tolist(), kept):
                if len(row) > k + 1:  # one more, as the query's own row may be among them
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    above = np.flatnonzero(row > least)
                    take = np.concatenate([above, np.flatnonzero(row == least)[: k + 1 - len(above)]])
                else:
                    take = np.arange(len(row))
                best.extend((-int(s), start + t) for s, t in zip(row[take].tolist(), take.tolist()) if part[t] != query_row)
        for n, best in enumerate(kept):
            best = sorted(best)[:k]
            out[0].extend([at + n] * len(best))
            out[1].extend(t for _, t in best)
            out[2].extend(-s for s, _ in best)
    return out


def _solved(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        of, row, score = [], [], []
        ids, rows, asked = left.column("vec_id").to_numpy(), left.column("uid").to_numpy(), right.column("uid").to_numpy()
        if len(left) and len(right):
            order = np.lexsort((rows, ids))
            ids, rows = ids[order], rows[order]
            of, row, score = best_products(matrix(right.column("vector")), asked, matrix(left.column("vector"))[order], rows, k)
        of, row = np.array(of, np.int64), np.array(row, np.int64)
        return pa.table({"uid": pa.array(asked[of], pa.int64()), "other": pa.array(rows[row], pa.int64()), "vec_id": pa.array(ids[row], pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def voronoi_top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    k: int = 5,
    fit_rows: int = 8192,
    most_pivots: int = 128,
    group_queries: int = 8192,
    block_rows: int = 65_536,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` largest inner products of each query row with all others: ``query_id, rank, vec_id, score``.

    ``vector_col`` holds whole numbers (any numeric type). ``group_queries`` and
    ``block_rows`` bound what a task holds; a small table is dealt to smaller blocks.
    """
    spark = vectors.sparkSession
    clean = vectors.withColumn("__query", is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce("__query", F.lit(False)).alias("query"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=True))
    parts = [_of_one_size(rows, n, k, fit_rows, most_pivots, group_queries, block_rows, seed) for rows, n in by_size(clean, "vector")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _of_one_size(clean: DataFrame, total: int, k: int, fit_rows: int, most_pivots: int, group_queries: int, block_rows: int, seed: int) -> DataFrame:
    spark = clean.sparkSession
    sample = sampled(clean, fit_rows, "vec_id", "vector")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    most = clean.agg(F.max(squares)).first()[0]
    pivots = k_means(lifted(sample, most), int(max(1, min(most_pivots, len(sample) // 16, math.sqrt(total)))), seed)

    def celled(batches):
        for batch in batches:
            x = lifted(matrix(batch.column(1)), most)
            cells = nearest(x, pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32)), pa.array(radii(x, pivots, cells))], ["vec_id", "vector", "query", "cell", "radius"])

    def query_celled(batches):
        for batch in batches:
            x = levelled(matrix(batch.column(2)), most)
            cells = nearest(x, pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32)), pa.array(radii(x, pivots, cells))], ["uid", "query_id", "vector", "cell", "radius"])

    # Once settled, a row's number is its own, whatever id it repeats.
    data = settle(clean.mapInArrow(celled, "vec_id long, vector array<double>, query boolean, cell int, radius double").withColumn("uid", F.monotonically_increasing_id()))
    queries = settle(data.where("query").select("uid", F.col("vec_id").alias("query_id"), "vector").mapInArrow(query_celled, "uid long, query_id long, vector array<double>, cell int, radius double"))

    # Summaries: one row per cell of queries, k + 1 per cell of candidates.
    asked = {r.cell: (r.n, r.radius) for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}
    parts = 64
    lowest = data.groupBy("cell", F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"), "radius").agg(F.count("*").alias("n"))
    ranked = lowest.withColumn("at", F.row_number().over(Window.partitionBy("cell", "part").orderBy("radius"))).where(F.col("at") <= k + 1)
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("radius"))).where(F.col("at") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in ranked.select("cell", "radius", "n").collect():
        near.setdefault(r.cell, []).extend([r.radius] * min(k + 1, r.n))
    bounds = needed(pivots, {i: u for i, (_, u) in asked.items()}, near, k)

    # Groups of query cells, filled in the order of cells; a cell with too many queries is several groups.
    groups: list[list[int]] = []
    splits: list[tuple[int, int, int]] = []  # cell, first group, number of groups
    filled = group_queries
    for cell in sorted(asked):
        n = asked[cell][0]
        if n > group_queries:
            count = -(-n // group_queries)
            splits.append((cell, len(groups), count))
            groups.extend([cell] for _ in range(count))
            filled = group_queries
        else:
            if filled + n > group_queries:
                groups.append([])
                filled = 0
            groups[-1].append(cell)
            filled += n
            splits.append((cell, len(groups) - 1, 1))
    dealt = F.broadcast(spark.createDataFrame(splits, "cell int, first int, count int"))  # one row per cell

    def sent(batches):
        for batch in batches:
            cells, r = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            rows, to = [], []
            for g, members in enumerate(groups):
                want = np.zeros(len(r), bool)
                for i in members:
                    low, high = bounds[i]
                    want |= (r >= low[cells]) & (r <= high[cells])
                found = np.flatnonzero(want)
                rows.append(found)
                to.append(np.full(len(found), g, np.int32))
            rows, to = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, to))
            for at in range(0, len(rows), 10_000):
                take = pa.array(rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(to[at : at + 10_000].astype(np.int32))], ["uid", "vec_id", "vector", "grp"])

    blocks = max(1, -(-total // block_rows), min(spark.sparkContext.defaultParallelism, total // 4096))
    left = data.select("uid", "vec_id", "vector", "cell", "radius").mapInArrow(sent, "uid long, vec_id long, vector array<double>, grp int").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    right = queries.join(dealt, "cell").select("uid", "vector", (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("count"))).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(_solved(k), "uid long, other long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "other")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("uid", "query_id"), "uid").select("query_id", "rank", "vec_id", "score")
