"""Vectors as Spark columns and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector is there, with finite components only, and (unless ``zero``) not all of them 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def by_size(vectors: DataFrame, column: str) -> list[tuple[DataFrame, int]]:
    """The rows of each number of components, and how many they are: only vectors of one size can be compared."""
    sizes = sorted(vectors.groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).collect())  # one row a size
    return [(vectors if len(sizes) == 1 else vectors.where(F.size(column) == r["size"]), r["n"]) for r in sizes]


def sampled(vectors: DataFrame, rows: int, id_column: str, column: str) -> np.ndarray:
    """The vectors of the ``rows`` rows whose ids (for rows of one id, vectors) have the smallest hashes."""
    found = vectors.orderBy(F.xxhash64(id_column), id_column, F.xxhash64(column)).limit(rows).select(column).toArrow()
    return matrix(found.column(0)) if len(found) else np.zeros((0, 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Number of the nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` clusters at most, by Lloyd's rounds from seeded distinct rows."""
    x = x[np.lexsort(x.T)]
    distinct = x[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])]
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres
