"""Exact Jaccard self-join on word shingles by prefixes under several token orders.

Two sets whose similarity reaches the threshold share a token among the first
``n - ceil(t * n) + 1`` of each, under *any* total order of tokens. Three orders
are used here. All put frequent tokens last, as far as a count sketch of bounded
size tells them from the rest (it never counts too low, and an order needs no
exact counts; where the corpus is too large for it, tokens of long lists are counted
one by one and prefixes taken again); they differ in the hash that ranks tokens of
one level. Candidates
share a token of their prefixes under the first order; before a pair is verified
its sizes must fit and its prefixes must share enough tokens under each of the
three. Enough is what a pair of those sizes must share in prefixes of that length,
given the threshold. For that test a class's prefixes travel as 16-bit hashes,
which can only add to what is shared; sets are read, from the texts again, for the
pairs that pass, once for each class.

Links are wanted per document, not all pairs of a group of copies:

* documents with the same set are one class; only classes are joined;
* a prefix token's list of at most ``LIGHT`` classes is first linked as a star
  around one member; a later round tests the pairs of members that are still in
  different components, so a list of near copies costs its length and not its
  square;
* longer lists that share members are a family. One with at most
  ``FAMILY_TOKENS`` shingles is searched breadth first by one task, which keeps
  an index of the prefixes under three orders of its own; a set once reached is
  never compared with another one reached;
* the lists of larger families stay tables keyed by token and take stars, around
  ever better linked members, in SQL; what is then still apart is joined by the
  token and one of the prefix under the second order together.

No list is cut short. Token hashes have 64 bits, equality of shingles is equality
of hashes. A class id is one half of a hash of 128 bits; the classes that share
that half (a few in 10^10) are told apart by the other.

Defined cases: a null or wordless text has an empty set and links with nothing;
fewer words than a shingle make one shingle; a text of any length is read whole;
each row of a repeated id is linked by its own text and returned; a row without an
id is linked and returned, too, but gives no name to its component (null where no
row has an id); of equally good centres of a star the smaller class id is taken,
which changes no result; other columns are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import settle
from lumentrail.llm.components import components

_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Bits of a sketch cell's address, and the pieces it travels in.
SKETCH_BITS, PIECES = 22, 16
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Lists of up to so many classes are joined pair by pair.
LIGHT = 64
#: Families of longer lists with up to so many shingles (8 bytes each, some ten times that in use) are searched by one task each.
FAMILY_TOKENS = 4_000_000
#: Shingles a cell of the sketch, on average, beyond which it can't tell frequent tokens from rare ones.
SATURATED = 1_024
#: Total orders of tokens that prefixes are taken under.
ORDERS = 3


def finished(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _places(k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the word at each of ``k`` places of a shingle is mixed with, before and after."""
    return tuple(np.array([_MIX[(i + ahead) % 8] for i in range(k)])[:, None] for ahead in (0, 3))


def shingle_set(text: str | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z lower-cased, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    at = len(h) - k + 1
    # Row i: the words i places on. All rows are mixed at once, as texts are short and each call has its price.
    before, after = _places(k)
    sums = finished(np.ndarray((k, at), np.uint64, h, strides=(8, 8)) + before)
    sums *= after
    h = finished(sums.sum(axis=0, dtype=np.uint64) + np.uint64(k if k < width else 0))
    h.sort()
    fresh = np.empty(at, bool)
    fresh[:1] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def halves(own: np.ndarray) -> tuple[int, int]:
    """A set's hash of 128 bits as two signed longs."""
    h = xxhash.xxh3_128_intdigest(own.tobytes())
    return tuple(int(np.uint64(x).view(np.int64)) for x in (h & (1 << 64) - 1, h >> 64))


def class_of(own: np.ndarray, clashing: frozenset) -> int:
    """The id of a set: one half of its hash, the other where several sets have the first."""
    low, high = halves(own)
    return high if low in clashing else low


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _fingerprints(width: int):
    """Rows of a document (doc, n, cls and the other half of its hash), and of the sketch (piece, counts) at a partition's end."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("other", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, seen = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32), set()
        some = False
        for batch in batches:
            docs, ns, classes, others = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, known, width)
                c, other = halves(own) if len(own) else (None, None)
                ns.append(len(own))
                classes.append(c)
                others.append(other)
                if c is not None and c not in seen:
                    if len(seen) < 200_000:
                        seen.add(c)
                    counts[_cells(own)] += 1  # a set's cells may meet: an undercount by one at most, and orders need no exact counts
                    some = True
            empty = [None] * len(docs)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (docs, ns, classes, others)), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], schema=schema)
        if some:
            for piece, part in enumerate(np.split(counts, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([piece], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=schema)

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // PIECES, np.uint32)
    for blob in table.column("counts"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _levels(prints: DataFrame) -> np.ndarray:
    """For each sketch cell 0 (light) or how far above a light cell it is, in powers of two. 4 MB, whatever the corpus."""
    parts = prints.where("piece is not null").select("piece", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("lot"))
    for keys in (("piece", "lot"), ("piece",)):
        parts = parts.groupBy(*keys).applyInArrow(_added, "piece int, counts binary")
        parts = parts.withColumn("lot", F.lit(0))
    total = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.uint32)
    for row in parts.select("piece", "counts").collect():
        total[row.piece] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    total = total.reshape(-1).astype(float)
    light = total.mean() + 6 * np.sqrt(total.mean()) + 32
    return np.maximum(0, np.ceil(np.log2(np.maximum(total, 1) / light))).astype(np.uint8)


def _flags(table: pa.Table) -> pa.Table:
    """A piece of the levels of tokens by how long their lists are: the highest of a cell's."""
    own = np.zeros((1 << SKETCH_BITS) // PIECES, np.uint8)
    own[table.column("cell").to_numpy() % len(own)] = np.ceil(np.log2(np.maximum(1, table.column("n").to_numpy() / LIGHT)))
    return pa.table({"piece": table.column("piece")[:1], "levels": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})


def _counted_levels(found: DataFrame) -> np.ndarray:
    """Levels of cells by the tokens that came to lists longer than ``LIGHT``, which are counted one by one: rare tokens share no cell's count with others."""
    rows = found.where("token is not null").select("token", "cls", "n")
    heavy = rows.where("cls is not null").select("token", "cls").distinct().groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > LIGHT)
    sizes = heavy.unionAll(rows.where("cls is null").select("token", "n"))
    cells = sizes.groupBy(F.shiftrightunsigned("token", 64 - SKETCH_BITS).alias("cell")).agg(F.max("n").alias("n"))
    pieces = cells.withColumn("piece", F.floor(F.col("cell") / ((1 << SKETCH_BITS) // PIECES)).cast("int"))
    levels = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.uint8)
    for row in pieces.groupBy("piece").applyInArrow(_flags, "piece int, levels binary").collect():  # PIECES rows
        levels[row["piece"]] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    return levels.reshape(-1)


def short_prefixes(own: np.ndarray, first: np.ndarray, height: np.ndarray) -> bytes:
    """The prefixes of a set under all orders (of the first: ``first``) as sorted 16-bit hashes. ``height``: the levels of its tokens."""
    prefixes = [finished(first)]
    for k in range(1, ORDERS):
        mixed = finished(own ^ _MIX[k])
        if height.any():
            prefixes.append(mixed[np.lexsort((mixed, height))[: len(first)]])
        else:
            prefixes.append(np.partition(mixed, len(first) - 1)[: len(first)])
    return b"".join(np.sort((h & np.uint64(0xFFFF)).astype(np.uint16)).tobytes() for h in prefixes)


def share_enough(x: bytes, n_x: int, y: bytes, n_y: int, percent: int) -> bool:
    """Whether the prefixes of two sets share, under each order, what sets of that similarity must share."""
    overlap = -(-percent * (n_x + n_y) // (100 + percent))
    a, b = (np.frombuffer(s, np.uint16).reshape(ORDERS, -1) for s in (x, y))
    least = max(1, min(a.shape[1] - n_x + overlap, b.shape[1] - n_y + overlap))
    for p, q in zip(a, b):
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        if int((q[at] == p).sum()) < least:
            return False
    return True


def _enough(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "n_x", "y", "n_y")))
            keep = [share_enough(x, n, y, m, percent) for x, n, y, m in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(levels: bytes, buckets: int, percent: int, width: int, clashing: frozenset):
    """Prefix tokens of each class (light ones packed by bucket, heavy ones as rows), and its short prefixes."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("short", pa.binary())])
    record = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(levels), np.uint8)
        known, seen = WordHashes(), set()
        held, rows = [], 0
        heavy: list[tuple] = []
        short: list[tuple] = []

        def flush():
            nonlocal held, rows, heavy, short
            if short:
                none = pa.nulls(len(short))
                classes, ns, shorts = zip(*short)
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(classes, pa.int64()), pa.array(ns, pa.int64()), none.cast(pa.int64()), pa.array(shorts, pa.binary())], schema=schema)
            if held:
                packed = np.concatenate(held)
                bucket = (packed["token"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                packed, bucket = packed[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                firsts = bucket[np.concatenate([[0], cuts])].tolist()
                blobs = [x.tobytes() for x in np.split(packed, cuts)]
                none = [None] * len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), pa.array(blobs, pa.binary()), *[pa.array(none, pa.int64())] * 4, pa.array(none, pa.binary())], schema=schema)
            if heavy:
                tokens, places = np.concatenate([t for t, _, _, _ in heavy]).view(np.int64), np.concatenate([at for _, at, _, _ in heavy]).astype(np.int64)
                lengths = [len(t) for t, _, _, _ in heavy]
                classes, ns = (np.repeat(np.array([h[k] for h in heavy], np.int64), lengths) for k in (2, 3))
                none = pa.nulls(len(tokens))
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), *map(pa.array, (tokens, classes, ns, places)), none.cast(pa.binary())], schema=schema)
            held, rows, heavy, short = [], 0, [], []

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, known, width)
                if not len(own):
                    continue
                c = class_of(own, clashing)
                if c in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                height = level[_cells(own)]
                order = np.lexsort((own, height)) if height.any() else np.arange(len(own))
                first = order[: prefix_length(len(own), percent)]
                is_heavy = height[first] > 0
                tokens = own[first]
                light = np.empty(int((~is_heavy).sum()), record)
                light["token"], light["cls"], light["n"] = tokens[~is_heavy], c, len(own)
                if len(light):
                    held.append(light)
                short.append((c, len(own), short_prefixes(own, tokens, height)))
                rows += len(tokens)
                if is_heavy.any():
                    heavy.append((tokens[is_heavy], np.flatnonzero(is_heavy), c, len(own)))
                if rows >= 1_000_000:
                    yield from flush()
        yield from flush()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct member lists, of two classes to ``LIGHT``, of a partition's light tokens, and longer ones as heavy rows; the lengths of long lists (rows without a class); heavy rows and a class's first short prefixes pass through."""
    schema = pa.schema([("list", pa.binary()), ("members", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("short", pa.binary())])
    classes: set[int] = set()
    record = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4")])
    blobs: list[bytes] = []
    for batch in batches:
        blobs += [blob for blob in batch.column("packed").to_pylist() if blob is not None]
        rows = batch.filter(pc.is_valid(batch.column("cls")))
        if len(rows):
            fresh = []
            for c, s in zip(rows.column("cls").to_pylist(), pc.is_valid(rows.column("short")).to_pylist()):
                fresh.append(not s or c not in classes)
                if s:
                    classes.add(c)
            rows = rows.filter(pa.array(fresh))
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([*(none.cast(schema.field(k).type) for k in range(3)), *(rows.column(c) for c in ("token", "cls", "n", "pos", "short"))], schema=schema)
    if not blobs:
        return
    packed = np.unique(np.concatenate([np.frombuffer(b, record) for b in blobs]))
    del blobs
    starts = np.flatnonzero(np.concatenate([[True], packed["token"][1:] != packed["token"][:-1]]))
    ends = np.append(starts[1:], len(packed))
    marks = np.flatnonzero(ends - starts > LIGHT)  # how long the lists of tokens are, also where another has the same members
    if len(marks):
        none = pa.nulls(len(marks))
        sizes = [pa.array(packed["token"][starts[marks]].astype(np.int64)), none.cast(pa.int64()), pa.array((ends - starts)[marks].astype(np.int64)), none.cast(pa.int64())]
        yield pa.RecordBatch.from_arrays([*(none.cast(schema.field(k).type) for k in range(3)), *sizes, none.cast(pa.binary())], schema=schema)
    seen, out, long_ = set(), [], []
    for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        members = packed["cls"][s:e]
        name = xxhash.xxh3_128_digest(members.tobytes())
        if name not in seen:
            seen.add(name)
            if e - s > LIGHT:
                long_.append((s, e))
            else:
                out.append((name, members.tolist(), packed["n"][s:e].tolist()))
    for at in range(0, len(out), 10_000):
        names, members, ns = (list(x) for x in zip(*out[at : at + 10_000]))
        none = pa.nulls(len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int64())), none, none, none, none, pa.nulls(len(names), pa.binary())], schema=schema)
    for s, e in long_:  # their places in the prefixes are not kept; 0 is always a right bound
        for at in range(s, e, 100_000):
            part = packed[at : min(e, at + 100_000)]
            rows = [part["token"].astype(np.int64), part["cls"], part["n"].astype(np.int64), np.zeros(len(part), np.int64)]
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays([*(none.cast(schema.field(k).type) for k in range(3)), *(pa.array(np.ascontiguousarray(r)) for r in rows), none.cast(pa.binary())], schema=schema)


def _sets(width: int, clashing: frozenset):
    """The sets of classes from one of their documents. An id may be of several texts: only the class's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            classes, sets = batch.column(0).to_pylist(), [shingle_set(t, known, width) for t in batch.column(1).to_pylist()]
            own = [(c, s.tobytes()) for c, s in zip(classes, sets) if len(s) and (c is None or class_of(s, clashing) == c)]
            own = [(class_of(np.frombuffer(s, np.uint64), clashing) if c is None else c, s) for c, s in own]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["cls", "tokens"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all sets which are joined by links, found breadth first.

    Candidates of a set share a token of its prefix under each of several orders,
    all of them rare tokens first; the index of prefixes is left to the sets not
    yet reached each time half of its sets are. A set already reached is never
    compared with another one reached.
    """
    n = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    counts, ends = np.bincount(ids), np.cumsum(n)
    own = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
    length = np.array([prefix_length(k, percent) for k in n.tolist()])
    prefixes, index = [], []
    for k in range(ORDERS):
        level = counts if k == 0 else np.ceil(np.log2(counts))
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((finished(np.arange(len(counts), dtype=np.uint64) ^ _MIX[k]), level))] = np.arange(len(counts))
        prefixes.append([np.partition(rank[o], q - 1)[:q] for o, q in zip(own, length.tolist())])
        token, holder = np.concatenate(prefixes[-1]), np.repeat(np.arange(len(sets)), length)
        order = np.argsort(token, kind="stable")
        index.append((token[order], holder[order]))
    mark, free, met = np.zeros(len(counts), bool), np.ones(len(sets), bool), np.zeros(len(sets), np.int8)
    held, left, links = len(sets), len(sets), []
    for start in range(len(sets)):
        if not free[start]:
            continue
        free[start], left = False, left - 1
        queue = [start]
        while queue and left:
            x = queue.pop()
            if 2 * left < held:
                index, held = [(t[free[h]], h[free[h]]) for t, h in index], left
            met[:] = 0
            for (token, holder), prefix in zip(index, prefixes):
                lo, hi = np.searchsorted(token, prefix[x]), np.searchsorted(token, prefix[x], "right")
                runs = [holder[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if a < b]
                if not runs:
                    break
                met[np.unique(np.concatenate(runs))] += 1
            near = np.flatnonzero((met == ORDERS) & free)
            near = near[100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x])]
            if len(near):
                mark[own[x]] = True
                both = np.add.reduceat(mark[np.concatenate([own[y] for y in near])].astype(np.int64), np.cumsum(n[near]) - n[near])
                mark[own[x]] = False
                near = near[100 * both >= percent * (n[near] + n[x] - both)]
            free[near], left = False, left - len(near)
            queue.extend(near.tolist())
            links.extend((x, y) for y in near.tolist())
    return links


def _by_second(levels: bytes, percent: int):
    """Classes once for each token of their prefix under the second order, in full: hashes of 16 bits would meet by chance in sets of thousands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(levels), np.uint8)
        for batch in batches:
            for c, tokens in zip(batch.column("cls").to_pylist(), batch.column("tokens").to_pylist()):
                own = np.frombuffer(tokens, np.uint64)
                second = second_prefix(own, level[_cells(own)], percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(second), c)), pa.array(second.view(np.int64))], ["cls", "second"])

    return run


def second_prefix(own: np.ndarray, height: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set under the second order, as 64-bit hashes."""
    mixed, n = finished(own ^ _MIX[1]), prefix_length(len(own), percent)
    return mixed[np.lexsort((mixed, height))[:n]]


def _family_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        rows = dict(zip(table.column("cls").to_pylist(), table.column("tokens").to_pylist()))
        classes = sorted(rows)
        links = spanning_links([np.frombuffer(rows[c], np.uint64) for c in classes], percent)
        return pa.table({"a": pa.array([classes[x] for x, _ in links], pa.int64()), "b": pa.array([classes[y] for _, y in links], pa.int64())})

    return run


def _few(df: DataFrame) -> DataFrame:
    """``df`` settled, to be broadcast if it has few rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS // 4 else df


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their
    shingle sets; ``component_id`` is the smallest id reachable by links.
    """
    if not 0 < Fraction(percent, 100) <= 1:
        raise ValueError("percent must be over 0 and at most 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prints = settle(texts.mapInArrow(_fingerprints(width), "doc long, n long, cls long, other long, piece int, counts binary"))
    rows = prints.where("piece is null").select("doc", "n", "cls", "other")
    total, unnamed = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("doc").isNull() & F.col("cls").isNotNull())).first()
    classes = settle(rows.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"), F.min("other").alias("lo"), F.max("other").alias("hi")))
    clashing = frozenset(r.cls for r in classes.where("lo <> hi").select("cls").collect())  # n^2 / 2^65 are to be expected
    firsts = classes.select("cls", "doc")
    if clashing:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("other")).otherwise(F.col("cls")))
        firsts = rows.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"))
    rows = rows.drop("other")
    height = _levels(prints)
    levels = zlib.compress(height.tobytes(), 1)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // 500_000 + 1)

    def lists(levels: bytes) -> DataFrame:
        emitted = texts.select("text").mapInArrow(_prefixes(levels, buckets, percent, width, clashing), "bucket int, packed binary, token long, cls long, n long, pos long, short binary")
        # One shuffle takes all kinds: packed light tokens go by bucket, the others are spread by class.
        dealt = emitted.repartition(buckets, F.coalesce(F.col("bucket").cast("long"), F.xxhash64("token", "cls")))
        return settle(dealt.select("packed", "token", "cls", "n", "pos", "short").mapInArrow(_lists, "list binary, members array<long>, ns array<long>, token long, cls long, n long, pos long, short binary"))

    found = lists(levels)
    if total > SATURATED << SKETCH_BITS:  # order again, by tokens that were counted exactly
        levels = zlib.compress(np.maximum(height, _counted_levels(found)).tobytes(), 1)
        found = lists(levels)
    light = found.where("list is not null").select("list", "members", "ns").dropDuplicates(["list"])
    shorts = found.where("short is not null").select("cls", "n", "short")
    heavy = found.where("token is not null and cls is not null").select("token", "cls", "n", "pos").distinct()
    # Of heavy tokens with the same members the first in the order is enough: it is the first that any two of them share.
    signs = [F.sum(F.xxhash64("cls", F.lit(k)).cast("decimal(20,0)")).alias(f"sign{k}") for k in (0, 1)]
    signs = heavy.groupBy("token").agg(F.count("*").alias("size"), *signs, F.min("pos").alias("pos"))
    signs = signs.where("size > 1").groupBy("size", "sign0", "sign1").agg(F.min_by("token", F.struct("pos", "token")).alias("token"))
    heavy = settle(heavy.join(_few(signs.select("token")), "token", "left_semi"))
    any_heavy = heavy.limit(1).count() > 0

    have: DataFrame | None = None

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``cls, tokens`` of some classes (``cls``) and of all asked for before, each read once, from its first document."""
        nonlocal have
        missing = wanted if have is None else wanted.join(have.select("cls"), "cls", "left_anti")
        missing = settle(firsts.join(missing, "cls", "left_semi"))
        count = missing.count()
        if have is not None and not count:
            return have
        known = F.broadcast(missing) if count <= BROADCAST_IDS else missing
        read = texts.join(known.where("doc is not null"), "doc").select("cls", "text").mapInArrow(_sets(width, clashing), "cls long, tokens binary")
        if unnamed:
            rest = texts.where("doc is null").select(F.lit(None).cast("long").alias("cls"), "text").mapInArrow(_sets(width, clashing), "cls long, tokens binary")
            read = read.unionAll(rest.join(known.where("doc is null").select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))
        read = settle(read)
        have = read if have is None else have.unionAll(read)
        return have

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes share enough under each order."""
        a, b = (shorts.select(F.col("cls").alias(p), F.col("short").alias(s), F.col("n").alias(n)) for p, s, n in (("a", "x", "n_x"), ("b", "y", "n_y")))
        return settle(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "n_x", "y", "n_y").mapInArrow(_enough(percent), "a long, b long"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """The likely pairs that reach the similarity."""
        sets = sets_of(ends(pairs))
        a, b = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
        return settle(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long").distinct())

    def fit(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def pair(x, y, n, m):
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")], fit(n, m)

    def in_reach(n, pos, m, other_pos):
        """Whether enough of both sets lies at and after a token that is the first they share."""
        needs = percent * (n + m)
        return ((100 + percent) * (n - pos) >= needs) & ((100 + percent) * (m - other_pos) >= needs)

    def starred(lists: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs of each heavy token's hub (``token, hub, hub_n, hub_pos``) with its other members."""
        columns, fits = pair(F.col("hub"), F.col("cls"), F.col("hub_n"), F.col("n"))
        reach = in_reach(F.col("hub_n"), F.col("hub_pos"), F.col("n"), F.col("pos"))
        return lists.join(hubs, "token").where(fits & reach & (F.col("hub") != F.col("cls"))).select(*columns)

    # Heavy lists that share members are a family. One of bounded size is searched whole by one task.
    inside = families = hubs = None
    if any_heavy:
        centres = _few(heavy.groupBy("token").agg(F.min("cls").alias("hub")))
        family = components(heavy.join(centres, "token").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
        family = family.withColumnRenamed("node", "cls").join(heavy.select("cls", "n").distinct(), "cls")
        small = family.groupBy("comp").agg(F.sum("n").alias("tokens")).where(F.col("tokens") <= FAMILY_TOKENS).select("comp")
        inside = settle(family.join(small, "comp", "left_semi").select("cls", F.col("comp").alias("family")))
        heavy = settle(heavy.join(inside, "cls", "left_anti"))  # the lists of larger families
        any_heavy = heavy.limit(1).count() > 0

    # First round: a star in every list.
    columns, fits = pair(F.col("members")[0], F.col("m.members"), F.col("ns")[0], F.col("m.ns"))
    tested = light.select("members", "ns", F.explode(F.slice(F.arrays_zip("members", "ns"), 2, LIGHT)).alias("m")).where(fits).select(*columns)
    if any_heavy:
        hubs = heavy.groupBy("token").agg(F.min(F.struct("cls", "n", "pos")).alias("h")).select("token", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
        hubs = _few(hubs)
        tested = tested.unionAll(starred(heavy, hubs))
    tested = settle(tested.distinct())
    pairs = likely(tested)
    if inside is not None:
        gathered = sets_of(ends(pairs).unionAll(inside.select("cls")).distinct()).join(inside, "cls")
        families = settle(gathered.groupBy("family").applyInArrow(_family_links(percent), "a long, b long"))
    links = verify(pairs)
    if families is not None:
        links = settle(links.unionAll(families))
    comps = components(links)

    def placed(members: DataFrame) -> DataFrame:
        """Members with their components."""
        return members.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def apart(members: DataFrame, key: str) -> DataFrame:
        """Members, with their components, of lists that are not all in one."""
        members = placed(members)
        several = members.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(key)
        return members.join(_few(several), key, "left_semi")

    # Second round: pairs of light lists that are still apart. Third and fourth: stars around the best linked members of heavy lists. Fifth: what is left of those, under two orders at once.
    for step in ("light", "heavy", "heavy", "rest"):
        if step == "light":
            members = light.where(F.size("members") > 2).select("list", F.explode(F.arrays_zip("members", "ns")).alias("m")).select("list", F.col("m.members").alias("cls"), F.col("m.ns").alias("n"))
            members = apart(members, "list")
            other = members.select("list", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
            more = members.join(other, "list").where("cls < cls2 and comp <> comp2").where(fit(F.col("n"), F.col("n2"))).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))
        else:
            if not any_heavy:
                continue
            members = settle(apart(heavy, "token"))
            if not members.limit(1).count():
                continue
            if step == "heavy":
                degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
                used = hubs.select("token", F.col("hub").alias("cls"))
                ranked = members.join(used, ["token", "cls"], "left_anti").join(degree, "cls", "left")
                best = ranked.groupBy("token").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "cls", "n", "pos")).alias("h")).select("token", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
                best = _few(best)
                hubs = settle(hubs.unionAll(best))
                more = starred(members, best)
            else:
                sets = sets_of(members.select("cls").distinct()).join(members.select("cls").distinct(), "cls", "left_semi")
                seconds = sets.mapInArrow(_by_second(levels, percent), "cls long, second long")
                dealt = settle(members.join(seconds, "cls").select("token", "cls", "n", "pos", "comp", "second"))
                other = dealt.select("token", "second", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
                reach = fit(F.col("n"), F.col("n2")) & in_reach(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"))
                more = dealt.join(other, ["token", "second"]).where("cls < cls2 and comp <> comp2").where(reach).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))
        more = settle(more.distinct().join(tested, ["a", "b"], "left_anti"))
        if not more.limit(1).count():
            continue
        tested = settle(tested.unionAll(more))
        new = verify(likely(more))
        links = settle(links.unionAll(new))
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(new))

    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("cls")).transform(_labelled, comps)


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Each document with the smallest id of its component of classes."""
    placed = rows
    if comps is not None:
        placed = placed.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("cls", F.coalesce("comp", "cls")).drop("comp")
    linked = placed.where("cls is not null")
    lowest = settle(linked.groupBy("cls").agg(F.min("doc_id").alias("component_id")))
    return (
        linked.join(lowest, "cls").select("doc_id", "n_shingles", "component_id")
        .unionAll(placed.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
