"""Quality by Bradley-Terry pairwise ranking.

From labelled rows come preference pairs (a good document over a bad one). A
weight vector is learned by logistic loss on the differences of their features,
so a document's score is its strength in the Bradley-Terry model. The cut is a
quantile of the scores: as many of the fitted rows lie above it as are good. The
score is then put through a logistic whose value at the cut is ``cut_score``.

Features come from the whole text, in any script: hashed 4-grams of its UTF-8
bytes (A-Z lower-cased), shares of character classes from one histogram of the
bytes, and repetition and length of its words.

Every labelled row is fitted on. Rows are dealt by the hash of their ids to groups of
about ``group_rows``, within which each row of the rarer class meets at least
``pairs_each`` seeded rows of the other, and each row of the other at least one; a
group of one class alone has no pair. Sums over groups are all that fitting needs of
them; tables keep features, strengths and ranks.

Defined cases: a null text is an empty one, whose features are all 0 and whose
score is defined; a text of any length is read whole, in bounded memory; repeated
rows are scored alike; strengths equal to the cut score ``cut_score``; a label
that two rows give differently counts both ways; without labelled rows of both
classes every text scores 0.5; other columns pass unchanged except ``score``,
which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.llm.common import settle

#: Ids up to this number are broadcast (12 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_CLASSES = ("!", "|", "$%&*#@^~+=<>{}[]\\/_", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:?", " ", "\n", "\"'()-", "abcdefghijklmnopqrstuvwxyz")
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _chars], _k] = 1
_TABLE[0xC0:, -1] = 1  # the first byte of any other character
#: Buckets of hashed n-grams, and the bytes hashed at a time.
BUCKETS, STEP = 256, 1 << 20
#: How far one hashed feature may move a score, of what one of the few others may.
N_GRAM_SHARE = 0.1
FEATURES = _TABLE.shape[1] + 4 + BUCKETS
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def n_gram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of the 4-grams of some bytes, by hashed bucket."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw) - 3, STEP):
        part = raw[at : at + STEP + 3].astype(np.uint32)
        n = len(part) - 3
        h = part[:n] * _MIX[0]
        for k in (1, 2, 3):
            h ^= part[k : k + n] * _MIX[k]
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
        h *= _MIX[0]
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def features(text: str | None) -> np.ndarray:
    """Of a whole text. Shares are compressed so that a little of a rare class tells."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    shares = np.bincount(raw, minlength=256) @ _TABLE / len(raw)
    words = text.split()
    n = max(1, len(words))
    k = _TABLE.shape[1]
    out[:k] = np.log1p(50 * shares)
    out[k : k + 4] = (
        math.log1p(20 * sum(map(operator.eq, words, words[1:])) / n),
        1 - len(set(words)) / n,
        math.log1p(len(words)) / 10,
        math.log1p(len(text) / n),
    )
    counts = n_gram_counts(np.frombuffer(data.lower(), np.uint8))
    out[k + 4 :] = np.sqrt(counts / max(1.0, counts.sum()))
    return out


def preference_pairs(y: np.ndarray, each: int, seed: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of winners and losers: every row of the rarer class meets ``each`` seeded rows of the other or more, so that every row of that is met."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    if not len(few):
        return few, few
    each = max(each, -(-len(many) // len(few)))
    n = len(few) * each
    a, b = np.repeat(few, each), np.concatenate([rng.permutation(many) for _ in range(-(-n // len(many)))])[:n]
    return (b, a) if few is bad else (a, b)


def pair_sums(x: np.ndarray, won: np.ndarray, lost: np.ndarray, w: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Slope and bend of the pairs' logistic loss at ``w``, on differences of features, a block of pairs at a time."""
    slope, bend = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for at in range(0, len(won), block):
        d = x[won[at : at + block]] - x[lost[at : at + block]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how unlikely the winner still is
        slope -= d.T @ p
        bend += (d * (p * (1 - p))[:, None]).T @ d
    return slope, bend


def newton(sums, size: int, penalty: np.ndarray, steps: int, small: float) -> np.ndarray:
    """Weights by ridge-penalised Newton steps; ``sums(w)`` gives slope and bend of the loss."""
    w = np.zeros(size)
    for _ in range(steps):
        slope, bend = sums(w)
        step = np.linalg.solve(bend + np.diag(penalty), slope + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < small:
            break
    return w


def pairwise_logistic(x: np.ndarray, won: np.ndarray, lost: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of the Bradley-Terry model on some rows at hand."""
    return newton(lambda w: pair_sums(x, won, lost, w), x.shape[1], np.full(x.shape[1], ridge), steps, 1e-6)


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    cut: float  # the strength at the quantile
    slope: float
    cut_score: float

    def column(self, text):
        """The score of a text column."""
        w, cut, slope, base = np.array(self.weights), self.cut, self.slope, math.log(self.cut_score / (1 - self.cut_score))

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            strengths = np.array([features(t) @ w for t in texts]) if len(texts) else np.zeros(0)
            return pd.Series(1 / (1 + np.exp(-np.clip(slope * (strengths - cut) + base, -30, 30))))

        return score(text)


def _packed(table: pa.Table) -> pa.Table:
    """A group's rows as two blocks; their order is not the cluster's."""
    rows = sorted(zip(table.column("x").to_pylist(), table.column("y").to_pylist()))
    return pa.table({"g": table.column("g")[:1], "x": pa.array([b"".join(x for x, _ in rows)], pa.binary()), "y": pa.array([bytes(y for _, y in rows)], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("g").to_numpy())
    total = sum(np.frombuffer(table.column("sums")[int(k)].as_py()) for k in order)
    return pa.table({"g": table.column("lot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(groups: DataFrame, count: int, f, lots: int = 16) -> np.ndarray:
    """The sum over groups, in their order, of what ``f(g, x, y)`` says of each: an array of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in ("g", "x", "y"))):
                own = f(g, np.frombuffer(x, np.float32).reshape(-1, FEATURES), np.frombuffer(y, np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.asarray(own, float).tobytes()], pa.binary())], ["g", "sums"])

    told = groups.mapInArrow(run, "g int, sums binary")
    if count > lots:
        told = told.withColumn("lot", F.col("g") % lots).groupBy("lot").applyInArrow(_added, "g int, sums binary")
    return sum(np.frombuffer(r["sums"]) for r in sorted(told.collect(), key=lambda r: r["g"]))  # ``lots`` rows at most


def quantile_cut(strengths: DataFrame, n: int, n_bad: int) -> float:
    """The middle of the widest gap between two ranks of ``s``, within half a percent of the rank ``n_bad``.

    Approximate quantiles tell where those ranks lie; only the rows there are sorted.
    """
    slack = max(1, n // 200)
    first, end = max(0, n_bad - slack), min(n, n_bad + slack)
    room = 2 + n // 2_000  # the quantiles' error is a fifth of it at most
    lo, hi = strengths.agg(F.percentile_approx("s", [max(0.0, (first - room) / n), min(1.0, (end + room) / n)], 10_000)).first()[0]
    below = strengths.where(F.col("s") < lo).count()
    w = Window.orderBy("s")
    ranked = strengths.where(F.col("s").between(lo, hi)).select("s", (F.row_number().over(w) - 1 + below).alias("rank"), F.lead("s").over(w).alias("next"))
    gap = ranked.where((F.col("rank") >= first) & (F.col("rank") < end - 1)).orderBy(F.desc(F.col("next") - F.col("s")), "rank").first()
    return (gap["s"] + gap["next"]) / 2


def fit_quality(docs: DataFrame, labels: DataFrame, *, group_rows: int = 8_192, pairs_each: int = 8, seed: int = 0, cut_score: float = 0.3) -> QualityModel:
    """A model of the rows of ``docs`` that ``labels`` (``doc_id``, ``quality``) marks: of all of them."""
    marked = settle(labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")))
    n = marked.count()
    count = max(1, -(-n // group_rows))
    marked = F.broadcast(marked) if n <= BROADCAST_IDS else marked
    rows = docs.select("doc_id", "text").join(marked, "doc_id").select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("g"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(x, pa.binary()), batch.column("y")], ["g", "x", "y"])

    groups = settle(rows.mapInArrow(featured, "g int, x binary, y int").groupBy("g").applyInArrow(_packed, "g int, x binary, y binary"))
    none = np.zeros(2 + 2 * FEATURES)
    n, n_good, *sums = none + _summed(groups, count, lambda g, x, y: np.concatenate([[len(y), y.sum()], x.sum(0, dtype=float), np.square(x, dtype=float).sum(0)]))
    if not 0 < n_good < n:
        return QualityModel((0.0,) * FEATURES, 0.0, 1.0, 0.5)
    mean, squares = np.split(np.array(sums) / n, 2)
    scale = np.sqrt(np.maximum(0, squares - mean * mean)) + 1e-3
    scale[-BUCKETS:] /= N_GRAM_SHARE

    def of_pairs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def told(g: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            slope, bend = pair_sums((x / scale).astype(np.float32), *preference_pairs(y, pairs_each, (seed, g)), w)
            return np.concatenate([slope, bend.ravel()])

        got = _summed(groups, count, told)
        return got[:FEATURES], got[FEATURES:].reshape(FEATURES, FEATURES)

    w = newton(of_pairs, FEATURES, np.ones(FEATURES), 25, 1e-6) / scale

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("x").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.float32).reshape(-1, FEATURES) @ w)], ["s"])

    cut = quantile_cut(settle(groups.mapInArrow(strengths, "s double")), int(n), int(n - n_good))
    total, square = _summed(groups, count, lambda g, x, y: [(x @ w - cut).sum(), np.square(x @ w - cut).sum()]) / n
    spread = math.sqrt(max(0.0, square - total * total)) + 1e-9

    def of_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def told(g: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.stack([(x @ w - cut) / spread, np.ones(len(x))], 1)
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        got = _summed(groups, count, told)
        return got[:2], got[2:].reshape(2, 2)

    slope = max(1e-3, float(newton(of_rows, 2, np.array([1.0, 1e-6]), 50, 1e-8)[0]) / spread)
    return QualityModel(tuple(map(float, w)), cut, slope, cut_score)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    return docs.withColumn("score", model.column(F.col(text_col)))
