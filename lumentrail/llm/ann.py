"""Approximate nearest neighbours by adaptive dimension scan.

Vectors lie in inverted lists; every vector is indexed. Centres are fitted on a
bounded sample in two levels, the second of what the first leaves over: a list's
centre is the sum of one of each, so that the lists grow with the square root of
the table and hold about as many rows as a block. Inside a probed list vectors
and queries are turned by a random rotation and compared in blocks of columns:
after each block a hypothesis test on the partial distance abandons the
candidates that can hardly come under the query's bound. The bound is the k-th
distance found in the query's nearest list.

How many lists are probed is calibrated on the sample: as many as hold
``coverage`` of its own nearest neighbours. (In the whole table neighbours are
nearer than in the sample, so more of them are covered.)

Lists are split into blocks of bounded size by a hash, so a vector that a third
of the rows share fills many blocks. A query travels once to each list it probes
(to each block of one that is larger than a block); only hits that beat its bound
come back.

Defined cases: null and zero vectors and those with null or non-finite components
take no part; vectors of each size are searched among themselves; rows that
repeat an id are rows of their own: each is searched, and is a candidate of the
other; equal distances go by the smaller id; with fewer candidates than ``k`` all
that lie in probed lists are returned, and all lists are probed where there are
few rows; other columns are not looked at; an empty table gives no rows.
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


class Lists:
    """Inverted lists around sums of a centre and a centre of what it leaves over."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int):
        self.first = k_means(sample, max(1, min(lists, 1024, len(sample) // 16)), seed)
        left = sample - self.first[nearest(sample, self.first)]
        self.second = k_means(left, max(1, min(-(-lists // len(self.first)), len(sample) // 64)), seed + 1)
        if len(self.second) == 1:
            self.second = np.zeros((1, sample.shape[1]))
        self.cross = ((self.first**2).sum(axis=1)[:, None] + (self.second**2).sum(axis=1)[None, :]) / 2 + self.first @ self.second.T

    def own(self, x: np.ndarray) -> np.ndarray:
        """Number of the list each row lies in."""
        a = nearest(x, self.first)
        return a * len(self.second) + nearest(x - self.first[a], self.second)

    def far(self, x: np.ndarray) -> np.ndarray:
        """Half the squared distance to each list's centre, less what a row has in common."""
        return (self.cross[None] - (x @ self.first.T)[:, :, None] - (x @ self.second.T)[:, None, :]).reshape(len(x), -1)


def calibrated_probes(sample: np.ndarray, lists: Lists, k: int, coverage: float, queries: int = 256) -> int:
    """Lists, by nearness to the query, that hold ``coverage`` of the sample's k nearest neighbours of some of its rows."""
    own = lists.own(sample)
    q = sample[: min(queries, len(sample))]
    far = (sample**2).sum(axis=1)[None, :] - 2 * q @ sample.T
    far[np.arange(len(q)), np.arange(len(q))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return lists.cross.size
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    ranks = np.concatenate([np.argsort(np.argsort(lists.far(q[i : i + 1])[0]))[own[near[i]]] for i in range(len(q))])
    return int(np.sort(ranks)[max(0, math.ceil(coverage * len(ranks)) - 1)]) + 1


def scan(candidates: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, step: int, epsilon: float, start: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated rows that stay in the race for the k nearest within ``bounds`` (squared; infinite where nothing is known)."""
    size = candidates.shape[1]
    x_sq, q_sq = (candidates**2).sum(axis=1), (queries**2).sum(axis=1)
    open_ = np.isinf(bounds)
    if open_.any() and len(candidates) > start > k:
        first = ((candidates[None, :start] - queries[open_][:, None]) ** 2).sum(axis=2)
        bounds = bounds.copy()
        bounds[open_] = np.partition(first, k, axis=1)[:, k]  # one more than k: the query's own row may be among them

    def limit(upto: int) -> np.ndarray:
        return bounds * (1.0 if upto == size else upto / size * (1 + epsilon / math.sqrt(upto)) ** 2) * (1 + 1e-9)

    # The first columns of all pairs at once; products lose a little of what differences keep, hence the slack.
    a, b = candidates[:, :step], queries[:, :step]
    partial = (a**2).sum(axis=1)[None, :] + (b**2).sum(axis=1)[:, None] - 2 * b @ a.T
    slack = 1e-12 * (x_sq[None, :] + q_sq[:, None])
    of, row = np.nonzero(partial <= limit(min(step, size))[:, None] + slack)
    partial = partial[of, row]
    for at in range(step, size, step):
        upto = min(size, at + step)
        partial = partial + ((candidates[row, at:upto] - queries[of, at:upto]) ** 2).sum(axis=1)
        stays = partial <= limit(upto)[of] + 1e-12 * (x_sq[row] + q_sq[of])
        of, row, partial = of[stays], row[stays], partial[stays]
    return of, row


def _searched(rotation: np.ndarray, k: int, step: int, epsilon: float):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = {name: [] for name in ("uid", "row", "score")}
        if len(left) and len(right):
            rows, asked = left.column("uid").to_numpy(), right.column("uid").to_numpy()
            x, q = matrix(left.column("vector")), matrix(right.column("vector"))
            turned, turned_q = np.ascontiguousarray(x @ rotation), q @ rotation
            bounds = right.column("bound").to_numpy(zero_copy_only=False)
            bounds = np.where(np.isnan(bounds), np.inf, bounds)
            ids = left.column("vec_id").to_numpy()
            per = max(1, 400_000 // len(x))  # pairs at a time, however many of them stay
            for at in range(0, len(q), per):
                part = slice(at, at + per)
                of, row = scan(turned, turned_q[part], bounds[part] ** 2, k, step, epsilon)
                of = of + at
                exact = np.sqrt(((x[row] - q[of]) ** 2).sum(axis=1))
                stays = (rows[row] != asked[of]) & (exact <= bounds[of])
                of, row, exact = of[stays], row[stays], exact[stays]
                order = np.lexsort((rows[row], ids[row], exact, of))
                of, row, exact = of[order], row[order], exact[order]
                best = np.arange(len(of)) - np.searchsorted(of, of) < k
                for name, values in (("uid", asked[of[best]]), ("row", row[best]), ("score", exact[best])):
                    found[name].append(values)
        flat = {name: np.concatenate(v) if v else np.zeros(0) for name, v in found.items()}
        row = flat["row"].astype(np.int64)
        return pa.table({"uid": pa.array(flat["uid"].astype(np.int64)), "other": pa.array(left.column("uid").to_numpy()[row] if len(row) else np.zeros(0, np.int64)), "vec_id": pa.array(left.column("vec_id").to_numpy()[row] if len(row) else np.zeros(0, np.int64)), "score": pa.array(flat["score"], pa.float64())})

    return run


def ann_search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    fit_rows: int = 16_384,
    most_lists: int = 65_536,
    coverage: float = 0.98,
    block_rows: int = 32_768,
    query_rows: int = 16_384,
    step: int = 16,
    epsilon: float = 2.1,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row: ``query_id, rank, vec_id, score`` (Euclidean distance).

    ``block_rows`` bounds a task's candidates, about; a small table is dealt to more,
    smaller blocks. ``query_rows`` does so for its queries: those that probe a list go in
    as many lots, each of which meets every block.
    """
    spark = vectors.sparkSession
    clean = vectors.withColumn("__query", is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce("__query", F.lit(False)).alias("query"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=False))
    parts = [_of_one_size(rows, n, k, fit_rows, most_lists, coverage, block_rows, query_rows, step, epsilon, seed) for rows, n in by_size(clean, "vector")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_size(clean: DataFrame, total: int, k: int, fit_rows: int, most_lists: int, coverage: float, block_rows: int, query_rows: int, step: int, epsilon: float, seed: int) -> DataFrame:
    sample = sampled(clean, fit_rows, "vec_id", "vector")
    lists = Lists(sample, int(min(most_lists, max(1, math.sqrt(total)))), seed)
    probes = calibrated_probes(sample, lists, k, coverage)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((sample.shape[1], sample.shape[1])))[0]

    def listed(batches):
        for batch in batches:
            own = lists.own(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["vec_id", "vector", "query", "list"])

    # Once settled, a row's number is its own, whatever id it repeats.
    indexed = settle(clean.mapInArrow(listed, "vec_id long, vector array<double>, query boolean, list int").withColumn("uid", F.monotonically_increasing_id()))
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n"))
    blocks = settle(sizes.select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    blocks = F.broadcast(blocks)  # one row a list: most_lists at most
    placed = indexed.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).select("list", "block", "uid", "vec_id", "vector")

    def probing(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            near = np.concatenate([np.argsort(lists.far(x[i : i + 32]), axis=1, kind="stable")[:, :probes] for i in range(0, len(x), 32)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["uid", "query_id", "vector", "lists"])

    queries = settle(indexed.where("query").select("uid", F.col("vec_id").alias("query_id"), "vector").mapInArrow(probing, "uid long, query_id long, vector array<double>, lists array<int>"))

    def search(asked: DataFrame) -> DataFrame:
        lots = F.broadcast(settle(asked.groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("lots"))))  # one row a list
        asked = asked.join(blocks, "list").join(lots, "list").withColumn("lot", F.pmod(F.xxhash64("uid"), F.col("lots")).cast("int"))
        asked = asked.select("uid", "vector", "bound", "list", "lot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        met = placed.join(lots, "list").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
        both = met.groupBy("list", "block", "lot").cogroup(asked.groupBy("list", "block", "lot"))
        return both.applyInArrow(_searched(rotation, k, step, epsilon), "uid long, other long, vec_id long, score double")

    order = Window.partitionBy("uid").orderBy("score", "vec_id", "other")
    near = settle(search(queries.select("uid", "vector", F.lit(None).cast("double").alias("bound"), F.col("lists")[0].alias("list"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    bounds = near.groupBy("uid").agg(F.count("*").alias("n"), F.max("score").alias("far")).select("uid", F.when(F.col("n") >= k, F.col("far")).alias("bound"))
    rest = queries.select("uid", "vector", F.explode(F.slice("lists", 2, max(1, probes))).alias("list")).join(bounds, "uid", "left")
    found = near.select("uid", "other", "vec_id", "score").unionByName(search(rest))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("uid", "query_id"), "uid").select("query_id", "rank", "vec_id", "score")
