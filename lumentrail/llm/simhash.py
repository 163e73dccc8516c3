"""SimHash near-dedup: BK-trees over the fingerprints of each shard.

A fingerprint has a bit for each of 64 majority votes of the hashes of a
document's shingles. Two fingerprints link at ``radius`` or fewer differing bits;
equal ones are one node, so copies cost a count.

Fingerprints are sharded so that near ones meet. ``radius`` differing bits leave
one of ``radius + 1`` bands of bits intact, so each fingerprint goes to one shard
for each band, keyed by the band's leading bits: as many of them as keep a shard at
about ``SHARD_MEAN`` fingerprints, whatever the corpus. A task builds the shard's
BK-tree (the children of a node are keyed by their Hamming distance to it) and
sends all its fingerprints down, following only edges within the radius of their
distance to a node. Of a shard's links a spanning forest leaves the task.

Fingerprints of all documents must not meet on the driver, so trees travel with
the shuffle that brings a shard's fingerprints together; they are not sent
from the driver to all tasks.

A shard of more than ``SHARD_MOST`` fingerprints is dealt again: by all bits of its
band and one of ``radius + 1`` bands of the others, which is as exact. What is
then still larger is cut to parts, and each two parts meet in a task. No pair is
left out at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import hashed, settle
from lumentrail.llm.components import components

BITS = 64
#: Fingerprints that a shard is to hold on average, and those beyond which it is dealt again.
SHARD_MEAN, SHARD_MOST = 1_024, 32_768
#: Pairs of a fingerprint and a node that are looked at together.
FRONTIER = 1_000_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's shingles, repeats included; A-Z lower-cased, words split at ASCII white space; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65_536):
        spans = zip(starts[at : at + 65_536].tolist(), ends[k - 1 :][at : at + 65_536].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(starts)).tolist())


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc", "print"])

    return run


class BKTree:
    """A BK-tree over distinct fingerprints: ``child[x, d]`` is the child of node x at distance d, or -1. Node 0 is the root."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.child = prints, np.full((len(prints), BITS + 1), -1, np.int32)
        edges = self.child.reshape(-1)
        left, above = np.arange(1, len(prints)), np.zeros(max(0, len(prints) - 1), np.int64)
        while len(left):  # all nodes go down together, a level a step; the first to take an edge becomes its child
            edge, first, of = np.unique(above * (BITS + 1) + np.bitwise_count(prints[left] ^ prints[above]), return_index=True, return_inverse=True)
            edges[edge] = left[first]
            above = left[first][of]
            left, above = left[left != above], above[left != above]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``queries``, node) within ``radius`` bits."""
        at, node, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(at):
            d = np.bitwise_count(queries[at] ^ self.prints[node]).astype(np.int64)
            hit = d <= radius
            found.append((at[hit], node[hit]))
            steps = []
            for delta in range(-radius, radius + 1):
                key = d + delta
                ok = np.flatnonzero((key >= 0) & (key <= BITS))
                below = self.child[node[ok], key[ok]]
                steps.append((at[ok[below >= 0]], below[below >= 0].astype(np.int64)))
            at, node = (np.concatenate(x) for x in zip(*steps))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, node)


def forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct fingerprints the position of its component's first one, by the links a BK-tree finds."""
    tree, root = BKTree(prints), np.arange(len(prints))
    step = max(1, FRONTIER // max(1, len(prints)))
    for at in range(0, len(prints), step):
        i, j = tree.near(prints[at : at + step], radius)
        a, b = root[i + at], root[j]
        for key in np.unique((np.maximum(a, b) * len(prints) + np.minimum(a, b))[a != b]).tolist():
            x, y = root[key // len(prints)], root[key % len(prints)]
            if x != y:
                root[root == max(x, y)] = min(x, y)
    return root


def _shard(radius: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("print").to_numpy()).view(np.uint64)
        root = forest(prints, radius)
        linked = np.flatnonzero(root != np.arange(len(prints)))
        return pa.table({"a": prints[linked].view(np.int64), "b": prints[root[linked]].view(np.int64)})

    return run


def _bands(bits: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``n`` bands that cover ``bits`` bits."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _low(x: Column, width: int) -> Column:
    return x.bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, radius: int = 4, *, mean: int = SHARD_MEAN, most: int = SHARD_MOST) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``print``: long) within ``radius`` bits, enough of them to join every component."""
    n, bands, x = prints.count(), _bands(BITS, radius + 1), F.col("print")
    lead = min(min(w for _, w in bands), max(1, math.ceil(math.log2(max(2, n / mean)))))  # leading bits of a band that key a shard
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("band"), _low(F.shiftrightunsigned(x, at + w - lead), lead).alias("bits")) for i, (at, w) in enumerate(bands)))
    dealt = prints.select("print", F.explode(keys).alias("k")).select("print", "k.band", "k.bits")
    large = settle(dealt.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most))
    n_large = large.count()
    if not n_large:
        return dealt.groupBy("band", "bits").applyInArrow(_shard(radius), "a long, b long")
    side = hashed(large, n_large)
    small = dealt.join(side, ["band", "bits"], "left_anti")
    found = small.groupBy("band", "bits").applyInArrow(_shard(radius), "a long, b long")

    again = dealt.join(side.drop("n"), ["band", "bits"], "left_semi")
    whole, rest = F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, (at, w) in enumerate(bands):  # the band's bits, and all others moved together
        mine = F.col("band") == i
        whole = F.when(mine, _low(F.shiftrightunsigned(x, at), w)).otherwise(whole)
        above = F.shiftleft(F.shiftrightunsigned(x, at + w), at) if at + w < BITS else F.lit(0).cast("long")
        rest = F.when(mine, above.bitwiseOR(_low(x, at)) if at else above).otherwise(rest)
    again = again.select("print", "band", whole.alias("whole"), rest.alias("rest"))
    within = _bands(BITS - max(w for _, w in bands), radius + 1)
    keys = F.array(*(F.struct(F.lit(j).alias("sub"), _low(F.shiftrightunsigned("rest", at), w).alias("value")) for j, (at, w) in enumerate(within)))
    again = settle(again.withColumn("k", F.explode(keys)).select("print", "band", "whole", "k.sub", "k.value"))
    shard = ["band", "whole", "sub", "value"]
    sizes = again.groupBy(*shard).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / most).cast("int")
    met = again.join(sizes, shard).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("print", *shard, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    return found.unionAll(met.groupBy(*shard, "p", "q").applyInArrow(_shard(radius), "a long, b long"))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``id_col, print, component_id`` for every row of ``docs``.

    ``print`` is the fingerprint as a signed long, ``component_id`` the smallest
    id reachable by links, the row's own included.

    Defined cases: a null or wordless text has fingerprint zero, which links like
    any other; fewer words than a shingle make one; texts of any length are taken
    whole; rows that repeat an id are linked by their own texts and returned each;
    a row without an id is linked and returned but gives no name to its component
    (null where no row has an id); other columns are not looked at, whatever their
    names; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = settle(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(width, seed), f"doc {id_type}, print long"))
    nodes = settle(prints.groupBy("print").agg(F.min("doc").alias("doc")))
    joined = components(links(nodes.select("print"), radius)).select(F.col("node").alias("print"), "comp")
    named = settle(nodes.join(joined, "print", "left").select("print", "doc", F.coalesce("comp", "print").alias("comp")))
    names = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    final = named.select("print", "comp").join(names, "comp").select("print", "component_id")
    return prints.join(final, "print").select(F.col("doc").alias(id_col), "print", "component_id")
