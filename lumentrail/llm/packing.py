"""Packing documents into training sequences with lexical neighbours.

Texts are tokenised once and the ids are settled. Document frequencies of token
ids are counted over the whole corpus (as many counts as the vocabulary has
entries). Documents are then dealt to shards of a bounded number of tokens, each
with an inverted index of its own and BM25 weights from the corpus-wide counts.

So that a seed's neighbours lie in its shard, documents are dealt by their terms
and not by where they are stored: the BM25 weights of a document's terms, under a
random projection, lead it down a tree whose splits are medians of a bounded
sample. A leaf that holds more than a shard (a group of copies can't be split) is
several shards, by a hash of the id.

A shard is packed greedily: a seed document opens a window, the unused documents
that BM25 ranks highest for the seed's terms fill it, and the one
that reaches the window's end is cut there and goes on in the next window, whose
seed it becomes. What remains at a shard's end is one shorter sequence, padded.

Only counts and the sample leave the executors. A shard is packed by one task
from settled ids, so a lost executor's work is done again alike.

Defined cases: a null or empty text is the end id alone; a document longer than a
window, however long, is cut into as many pieces as it takes; rows that repeat an
id are packed each for itself; of neighbours with the same score the one
stored earlier comes first; an empty table gives no pieces; other columns
are not looked at.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import settle

#: Ids are kept as 16-bit integers; larger vocabularies need another type here.
ID = np.dtype("<u2")
#: The tokenizer's word rule for texts of these characters, where Python's classes agree with Unicode's letters and numbers.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¿-ÖØ-öø-ſ‐-‧]*")
_PIECES = re.compile(r" ?[A-Za-zÀ-ſ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9À-ſ]+|\s+(?!\S)|\s+")
#: A run of Unicode's white space that is too long for the library's own word rule, which recurses over it.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class Encoder(dict):
    """Ids of texts under a byte-level BPE vocabulary; pieces of words are remembered up to a bound.

    ``ranks`` is the vocabulary as a ``tiktoken`` file, ``pattern`` its word
    rule. Ids are those of the same vocabulary in ``tokenizers``.
    """

    def __init__(self, ranks: bytes, pattern: str, remembered: int = 400_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.remembered = remembered

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding._encode_single_piece(piece), ID).tobytes()
        if len(self) >= self.remembered:
            self.clear()
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text of any length.

        A long run of white space is a piece of its own under the word rule, all
        but its last character where something follows: it is cut out here.
        """
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _PIECES.findall(text)))
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            upto = run.end() - (run.end() < len(text))
            out += [self._ordinary(text[at : run.start()]), self[text[run.start() : upto]]]
            at = upto
        return b"".join([*out, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), ID).tobytes()


def chunks(docs: list[np.ndarray], tokens: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Documents in runs of about so many tokens."""
    ends = np.cumsum([len(d) for d in docs])
    cuts = np.searchsorted(ends, np.arange(tokens, ends[-1] + tokens, tokens)) + 1 if len(docs) else []
    bounds = np.unique(np.minimum([0, *cuts, len(docs)], len(docs))).tolist()
    return (docs[a:b] for a, b in zip(bounds, bounds[1:]))


def term_runs(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, times), by document and then by id."""
    wide = np.uint32 if len(docs) <= 1 << 16 else np.uint64
    key = (np.repeat(np.arange(len(docs), dtype=wide), [len(d) for d in docs]) << wide(16)) | np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, key = np.diff(np.append(first, len(key))), key[first]
    return (key >> wide(16)).astype(np.int64), (key & wide(0xFFFF)).astype(np.int64), times


_KEPT: dict[tuple, Encoder] = {}


def kept_encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary, with what it remembers: a worker's tasks share it."""
    key = (zlib.crc32(ranks), len(ranks), pattern)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(ranks, pattern)
    return _KEPT[key]


def _tokenised(ranks, pattern: str, end_id: int, size: int):
    """Documents' ids, and at a partition's end one row that counts the documents of each id (then of all, then all tokens)."""
    end = np.array([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(ranks.value, pattern)
        held, id_type = np.zeros(size + 2, np.int64), None
        for batch in batches:
            id_type = batch.column(0).type
            ids = [encoder.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
            for part in chunks([np.frombuffer(blob, ID) for blob in ids]):
                held[:size] += np.bincount(term_runs(part)[1], minlength=size)
            held[size:] += (len(ids), sum(map(len, ids)) // ID.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64()))], ["doc_id", "ids", "held"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([held.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids", "held"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
        total = rows.sum(axis=0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])


class Shard:
    """An inverted index over some documents' ids, with BM25 scores and marks of use.

    Terms of at least one in ``share`` documents are a dense matrix instead of postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, share: int, k1: float = 1.2, b: float = 0.75):
        self.docs = docs
        lengths = np.array([len(d) for d in docs])
        # One number for each token, by document and then by id; its runs are the postings.
        wide = np.uint32 if len(docs) <= 1 << 16 else np.uint64
        key = (np.repeat(np.arange(len(docs), dtype=wide), lengths) << wide(16)) | np.concatenate(docs).astype(wide)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times, key = np.diff(np.append(first, len(key))), key[first]
        doc, self.doc_term = (key >> wide(16)).astype(np.int32), (key & wide(0xFFFF)).astype(np.uint16)
        norm = k1 * (1 - b + b * lengths / mean_length)
        self.doc_weight = (idf[self.doc_term] * (times * (k1 + 1) / (times + norm[doc]))).astype(np.float32)
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(docs)))])
        by_term = np.argsort(self.doc_term, kind="stable")  # a radix sort of 16-bit ids: documents ascend
        term, self.posting_doc, self.weight = self.doc_term[by_term], doc[by_term], self.doc_weight[by_term]
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))
        self.unused = np.ones(len(docs), bool)
        held = np.diff(self.starts)
        common = np.flatnonzero((held > 1) & (held * share >= len(docs)))
        self.column = np.full(len(idf), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(docs), len(common)), np.float32)
        dense = self.column[term] >= 0
        self.dense[self.posting_doc[dense], self.column[term[dense]]] = self.weight[dense]
        self.asked = np.zeros(len(idf), bool)

    def scores(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of some documents for the terms ``own``."""
        first, lengths = self.doc_starts[docs], self.doc_starts[docs + 1] - self.doc_starts[docs]
        begins = np.cumsum(lengths) - lengths
        at = np.repeat(first - begins, lengths) + np.arange(lengths.sum())
        self.asked[own] = True
        found = np.add.reduceat(np.where(self.asked[self.doc_term[at]], self.doc_weight[at], 0.0), begins)
        self.asked[own] = False
        return found

    def terms(self, doc: int) -> np.ndarray:
        return self.doc_term[self.doc_starts[doc] : self.doc_starts[doc + 1]].astype(np.int64)

    def compacted(self) -> np.ndarray:
        """Takes used documents out of the index; the old numbers of those left."""
        keep = self.unused
        new = np.cumsum(keep) - 1
        stays, own = keep[self.posting_doc], np.repeat(keep, np.diff(self.doc_starts))
        self.starts = np.concatenate([[0], np.cumsum(stays)])[self.starts]
        self.posting_doc, self.weight = new[self.posting_doc[stays]].astype(np.int32), self.weight[stays]
        self.doc_term, self.doc_weight = self.doc_term[own], self.doc_weight[own]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.diff(self.doc_starts)[keep])])
        self.docs, self.dense, self.unused = [d for d, k in zip(self.docs, keep) if k], self.dense[keep], keep[keep]
        return np.flatnonzero(keep)

    def neighbours(self, own: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` unused documents of highest score for all of a seed's terms ``own``, ties to the earlier one.

        Sums of single precision find the documents that may be among them, and
        those are scored again in double precision.
        """
        own = own[self.starts[own + 1] > self.starts[own]]
        columns = self.column[own]
        wanted = np.zeros(self.dense.shape[1], np.float32)
        wanted[columns[columns >= 0]] = 1
        score = self.dense @ wanted
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in own[columns < 0].tolist()]
        if spans:
            score = score + np.bincount(np.concatenate([self.posting_doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.docs))
        found = np.flatnonzero((score > 0) & self.unused)
        if len(found) > most:
            reached = score[found]
            found = found[reached >= np.partition(reached, len(found) - most)[len(found) - most] * (1 - 1e-3)]
        if not len(found):
            return found
        return found[np.lexsort((found, -self.scores(found, own)))[:most]]


def packed_order(shard: Shard, window: int, most: int = 16) -> list[int]:
    """The order in which documents enter the stream of windows; ``most`` neighbours are asked for at first, then more.

    The index is left to those unused each time a fifth of its documents is used.
    """
    order, at, seed, next_free = [], 0, None, 0
    names, used = np.arange(len(shard.docs)), 0

    def take(doc: int) -> None:
        nonlocal at, used
        shard.unused[doc] = False
        order.append(int(names[doc]))
        at, used = at + len(shard.docs[doc]), used + 1

    while True:
        if used > 64 and 5 * used > len(shard.docs):
            names, used, next_free = names[shard.compacted()], 0, 0
        while next_free < len(shard.docs) and not shard.unused[next_free]:
            next_free += 1
        if next_free == len(shard.docs):
            return order
        if seed is None:  # a new seed opens what is left of the window
            seed = shard.terms(next_free)
            take(next_free)
            continue
        end = (at + window - 1) // window * window
        if at == end:
            seed = None
            continue
        asked, more, last = most, True, seed
        while at < end and more:
            found = shard.neighbours(seed, asked).tolist()
            for doc in found:
                last = shard.terms(doc)
                take(doc)
                if at >= end:
                    break
            asked, more = 4 * asked, len(found) == asked
        # A document cut at the window's end seeds the next; where no unused document scores, another seed goes on.
        seed = last if at > end else None


class Projection:
    """Documents as short vectors: BM25 weights of their terms under seeded signs, of length 1."""

    def __init__(self, idf: np.ndarray, mean_length: float, dims: int, seed: int, k1: float = 1.2, b: float = 0.75):
        self.idf, self.mean_length, self.k1, self.b = idf, mean_length, k1, b
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (len(idf), dims))

    def of(self, docs: list[np.ndarray], tokens: int = 200_000) -> np.ndarray:
        """Some documents' vectors, worked out for about so many tokens at a time; no document is empty."""
        parts = [self._some(part) for part in chunks(docs, tokens)]
        return np.concatenate(parts) if parts else np.zeros((0, self.signs.shape[1]), np.float32)

    def _some(self, docs: list[np.ndarray]) -> np.ndarray:
        (doc, term, times), lengths = term_runs(docs), np.array([len(d) for d in docs])
        norm = self.k1 * (1 - self.b + self.b * lengths / self.mean_length)
        weight = (self.idf[term] * (times * (self.k1 + 1) / (times + norm[doc]))).astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        x = np.add.reduceat(self.signs[term] * weight[:, None], starts, axis=0)
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + np.float32(1e-9))


@dataclass(frozen=True)
class Tree:
    """Nodes of a binary tree of splits; a leaf's children are -1, and it has a first shard and a number of shards."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (rows := np.flatnonzero(self.children[at, 0] >= 0)).size:
            right = (x[rows] * self.normals[at[rows]]).sum(axis=1) > self.cuts[at[rows]]
            at[rows] = self.children[at[rows], right.astype(int)]
        return at


def grown(x: np.ndarray, sizes: np.ndarray, total: float, shard_tokens: int, least_rows: int = 8) -> Tree:
    """A tree whose splits lie between the two means of their rows.

    ``sizes``: the rows' tokens, whose shares of ``total`` foretell what a leaf
    holds. Rows are split down to a quarter of a shard; leaves that are near in
    the tree then fill a shard together, and one that holds more is several.
    """
    normals, cuts, children, rows = [], [], [], [np.arange(len(x))]
    scale = total / max(1.0, sizes.sum())
    leaves, open_ = [], [0]
    while open_:
        node = open_.pop()
        while len(cuts) < len(rows):
            normals.append(np.zeros(x.shape[1], np.float32))
            cuts.append(np.float32(0))
            children.append((-1, -1))
        own = rows[node]
        near = np.ones(len(own), bool)
        if len(own) >= 2 * least_rows and scale * sizes[own].sum() > shard_tokens / 4:
            one = x[own[np.argmax(((x[own] - x[own].mean(axis=0)) ** 2).sum(axis=1))]]
            other = x[own[np.argmax(((x[own] - one) ** 2).sum(axis=1))]]
            for _ in range(8):  # two means
                cuts[node] = np.float32(((other**2).sum() - (one**2).sum()) / 2)
                normals[node] = (other - one).astype(np.float32)
                near = (x[own] * normals[node]).sum(axis=1) <= cuts[node]
                if near.all() or not near.any():
                    break
                one, other = x[own[near]].mean(axis=0), x[own[~near]].mean(axis=0)
        if near.all() or not near.any():
            leaves.append(node)
            continue
        children[node] = (len(rows), len(rows) + 1)
        open_ += [len(rows) + 1, len(rows)]
        rows += [own[near], own[~near]]
    first, parts = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
    shards, filled = 0, 0.0
    for leaf in leaves:  # depth first
        tokens = scale * sizes[rows[leaf]].sum()
        if tokens > shard_tokens:
            shards += filled > 0
            first[leaf], parts[leaf], filled = shards, math.ceil(tokens / shard_tokens), 0.0
            shards += int(parts[leaf])
        else:
            if filled + tokens > shard_tokens:
                shards, filled = shards + 1, 0.0
            first[leaf], filled = shards, filled + tokens
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(cuts, np.float32), np.array(children).reshape(-1, 2), first, parts)


def _sampled(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection(*model.value)
        for batch in batches:
            docs = [np.frombuffer(blob, ID) for blob in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(projection.of(docs).tolist(), pa.list_(pa.float32())), pa.array([len(d) for d in docs], pa.int64())], ["x", "tokens"])

    return run


def _dealt(model, tree):
    """Documents with their shard, and their place among the settled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        projection, splits = Projection(*model.value), tree.value
        partition, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(at, at + len(batch))
            at += len(batch)
            leaf = np.zeros(len(batch), np.int64)
            if len(splits.cuts) > 1:
                leaf = splits.leaves(projection.of([np.frombuffer(blob, ID) for blob in batch.column(1).to_pylist()]))
            shard = splits.first[leaf] + (partition * 7919 + place) % splits.parts[leaf]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard), pa.array((partition << 33) + place)], ["doc_id", "ids", "shard", "place"])

    return run


def _packed(idf_blob, mean_length: float, window: int, shard_tokens: int, share: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(ids: list, docs: list[np.ndarray], idf: np.ndarray, first_sequence: int):
        shard = Shard(docs, idf, mean_length, share)
        total = sum(map(len, docs))
        lengths = [window] * (total // window) + [total % window] * (total % window > 0)
        rows, sequence, offset = [], 0, 0
        for d in packed_order(shard, window):
            start, own = 0, docs[d]
            while start < len(own):
                take = min(len(own) - start, lengths[sequence] - offset)
                rows.append((ids[d], start, take, zlib.crc32(own[start : start + take].astype("<u4").tobytes()), len(own), first_sequence + sequence, offset))
                start, offset = start + take, offset + take
                if offset == lengths[sequence]:
                    sequence, offset = sequence + 1, 0
        return rows, first_sequence + len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf = np.frombuffer(idf_blob.value, np.float64)
        sequence = TaskContext.get().partitionId() << 40  # a partition's numbers are its own
        ids, docs, size, id_type, now = [], [], 0, None, None

        def flush():
            nonlocal ids, docs, size, sequence
            if docs:
                rows, sequence = pieces(ids, docs, idf, sequence)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)
            ids, docs, size = [], [], 0

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, blob, shard in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(blob, ID)
                if size and (shard != now or size + len(own) > 2 * shard_tokens):  # shards are as large as the sample foretells
                    yield from flush()
                now = shard
                ids.append(doc_id)
                docs.append(own)
                size += len(own)
        yield from flush()

    return run


def pack(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    vocabulary: int = 50_257,
    shard_tokens: int = 4_000_000,
    share: int = 8,
    fit_docs: int = 65_536,
    dims: int = 32,
    seed: int = 7,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    ``shard_tokens`` is what a shard holds about (twice that at most); terms of at
    least one in ``share`` documents of a shard are kept as a matrix, of at most
    ``share`` cells a posting. The tree is grown on ``fit_docs`` documents at most.
    """
    if vocabulary > 1 << 16 or window & (window - 1):
        raise ValueError("the vocabulary must fit 16 bits and the window be a power of two")
    spark = docs.sparkSession
    context = spark.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = settle(texts.mapInArrow(_tokenised(context.broadcast(ranks), pattern, end_id, vocabulary), f"doc_id {id_type}, ids binary, held array<long>"))
    tokens = found.where("ids is not null").select("doc_id", "ids")
    counts = found.where("held is not null").select("held").mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(vocabulary + 2)
    for row in counts:  # as many rows as the vocabulary has entries
        held[row.id] = row.n
    n_docs, n_tokens = held[vocabulary], held[vocabulary + 1]
    idf = np.log1p((n_docs - held[:vocabulary] + 0.5) / (held[:vocabulary] + 0.5))
    mean_length = max(1.0, n_tokens / max(1.0, n_docs))
    model = context.broadcast((idf, mean_length, dims, seed))

    leaves = n_tokens / shard_tokens
    wanted = min(fit_docs, 64 * leaves) if leaves > 1 else 0
    x, sizes = np.zeros((0, dims), np.float32), np.zeros(0)
    if wanted:
        drawn = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / n_docs))
        found = tokens.where(drawn).select("ids").mapInArrow(_sampled(model), "x array<float>, tokens long").limit(2 * fit_docs).toArrow()
        x, sizes = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, dims), found.column("tokens").to_numpy()
        order = np.lexsort([*x.T, sizes])
        x, sizes = x[order], sizes[order]
    tree = grown(x, sizes, n_tokens, shard_tokens)
    if not len(x):  # one shard, or (with no row in the draw) as many as it takes
        tree = replace(tree, parts=np.array([max(1, math.ceil(leaves))]))
    shards = int((tree.first + tree.parts).max())
    dealt = tokens.mapInArrow(_dealt(model, context.broadcast(tree)), f"doc_id {id_type}, ids binary, shard long, place long")
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 20_000))
    dealt = dealt.repartitionById(tasks, F.col("shard").cast("int")).sortWithinPartitions("shard", "place").select("doc_id", "ids", "shard")
    rows = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(_packed(context.broadcast(idf.tobytes()), mean_length, window, shard_tokens, share), rows)
