"""Ranked lexical search on a bit-sliced impact index.

A term adds to a document's score an integer impact, which is known when the
index is built. Documents are numbered within blocks; a term's postings in a block
are kept as one bitmap for each bit of their impacts. A query adds the numbers of
its terms for all documents of a block at once, as a binary adder does: bit by bit,
with the carries as bitmaps. The k largest sums are found from the most
significant slice down: documents with the slice's bit go before those without,
until k are left; of equal sums the smaller ids are taken.

Slices are kept for the 64-bit words of a bitmap in which the term occurs, so that
a rare term costs little. Blocks close at ``BLOCK_DOCS`` documents or
``BLOCK_POSTINGS`` postings, whichever is first: that bounds a task's memory. Each
block is searched for all queries of a batch, and ranked lists of blocks are merged
by a window that Spark limits before its shuffle.

Only terms that some query asks for are indexed. Documents are read once, with a
filter of fixed size (``FILTER_BITS`` bits, whatever the queries) that passes those
terms and few others; the join that brings the weights takes the others out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.llm.common import settle

#: A term for Java's regular expressions: a run of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8: other bytes become spaces, A-Z lower-cased.
BYTES = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 1_000_000
#: Bits of the filter of query terms (1 MB), which travels to all tasks.
FILTER_BITS = 23
#: About so many query terms, repeats in other queries counted, are searched for together.
BATCH_TERMS = 250_000
#: Terms of all queries up to which their weights are broadcast (some 40 bytes each).
BROADCAST_TERMS = 200_000

INDEX = "block long, term string, places binary, slices binary, n_bits int, ids array<long>"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def _filter(terms: DataFrame) -> bytes:
    """A bitmap of the hashes of ``term``: at most 2^FILTER_BITS / 32 rows reach the driver."""
    cells = terms.select(F.pmod(F.xxhash64("term"), F.lit(1 << FILTER_BITS)).alias("cell"))
    rows = cells.groupBy(F.expr("int(cell div 32)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(cell % 32)))").alias("bits"))
    bitmap = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    for row in rows.collect():
        bitmap[row["at"]] = row["bits"]
    return bitmap.tobytes()


class _Asked(dict):
    """Whether some query may ask for a term, remembered up to a bound."""

    def __init__(self, bitmap: bytes):
        self.bitmap = np.frombuffer(bitmap, np.uint32)

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= 300_000:
            self.clear()
        cell = xxhash.xxh64_intdigest(term, 42) & (1 << FILTER_BITS) - 1
        self[term] = found = bool(int(self.bitmap[cell >> 5]) >> (cell & 31) & 1)
        return found


def _counted(bitmap: bytes):
    """Of each document with a term: its block, its place there, its number of terms, and the terms that are asked for with their counts."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, block, place, postings = _Asked(bitmap), TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else ()
                if not found:
                    continue
                own = [(t, c) for t, c in Counter(found).items() if asked[t]]
                if place == BLOCK_DOCS or place and postings + len(own) > BLOCK_POSTINGS:
                    block, place, postings = block + 1, 0, 0
                rows.append((block, place, doc_id, len(found), [t for t, _ in own], [c for _, c in own]))
                place, postings = place + 1, postings + len(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def sliced(places: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap words that hold a posting, a row of those words for each bit of the impacts). ``places`` ascend."""
    words, first = np.unique(places >> 6, return_index=True)
    bit = np.uint64(1) << (places & 63).astype(np.uint64)
    rows = []
    for b in range(int(impacts.max()).bit_length()):
        rows.append(np.bitwise_or.reduceat(np.where(impacts >> b & 1, bit, np.uint64(0)), first))
    return words.astype(np.uint32), np.array(rows, np.uint64).reshape(len(rows), len(words))


def _index(table: pa.Table) -> pa.Table:
    """The slices of each term of a block, and a row of the ids of its documents; places are in the order of ids, null last."""
    block = table.column("block")[0].as_py()
    places, ids = table.column("place").to_numpy(), table.column("id")
    at, first = np.unique(places, return_index=True)
    own = [ids[int(i)].as_py() for i in first]
    order = sorted(range(len(own)), key=lambda i: (own[i] is None, own[i] or 0, i))
    moved = np.zeros(int(at.max()) + 1, np.int64)
    moved[at[order]] = np.arange(len(order))
    places, impacts = moved[places], table.column("impact").to_numpy()
    coded = table.column("term").combine_chunks().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    by = np.lexsort((places, codes))
    rows = [(block, None, None, None, None, [own[i] for i in order])]
    for part in np.split(by, np.flatnonzero(np.diff(codes[by])) + 1):
        words, slices = sliced(places[part], impacts[part])
        rows.append((block, names[codes[part[0]]], words.tobytes(), slices.tobytes(), len(slices), None))
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["block", "term", "places", "slices", "n_bits", "ids"])


def impact_index(docs: DataFrame, asked: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The settled index (``INDEX``) of the terms in ``asked`` (``term``, distinct) over all of ``docs``, whose ids are longs.

    A row for each term of a block, after one (``term`` null) with the block's ids by
    place. A block's rows were made by one task and lie together, so a search needs no shuffle.
    """
    asked = settle(asked)
    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = settle(counted.mapInArrow(_counted(_filter(asked)), "block long, place int, id long, n long, terms array<string>, tfs array<long>"))
    corpus = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = corpus["docs"], max(1, corpus["terms"] or 0)
    postings = counted.select("block", "place", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("block", "place", "id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = settle(held.join(asked, "term").select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")))
    weights = F.broadcast(weights) if weights.count() <= BROADCAST_TERMS else weights
    m = F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L")
    impact = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    weighed = postings.join(weights, "term").withColumn("m", m).select("block", "place", "id", "term", impact.alias("impact")).where("impact > 0")
    return settle(weighed.groupBy("block").applyInArrow(_index, INDEX))


def add(sums: np.ndarray, words: np.ndarray, slices: np.ndarray) -> None:
    """Adds a term's sliced impacts to the sliced ``sums`` of a block, in place: full adders from the least significant slice up."""
    carry = np.zeros(len(words), np.uint64)
    for level, x in enumerate(slices):
        a = sums[level, words]
        half = a ^ x
        sums[level, words] = half ^ carry
        carry = (a & x) | (carry & half)
    level = len(slices)
    while carry.any():
        a = sums[level, words]
        sums[level, words] = a ^ carry
        carry &= a
        level += 1


def largest(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of the k largest positive sums, from the most significant slice down; of equal ones the smaller places."""
    sure, open_ = np.zeros(sums.shape[1], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for row in sums[::-1]:
        both = sure | (open_ & row)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            open_ = open_ & row
        else:
            sure, open_ = both, open_ & ~row
            if n == k:
                break
    places = _set(sure)
    places = np.concatenate([places, _set(open_)[: k - len(places)]])
    bits = (sums[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return places, (bits << np.arange(len(sums), dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64).astype(np.int64)


def _set(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(queries: list[tuple[int, list[str]]], k: int):
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    wanted = {t for _, terms in queries for t in terms}

    def searched(ids: list, terms: dict) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int | None, int]] = []
        for query, asked in queries:
            own = [terms[t] for t in asked if t in terms]
            if own:
                most = sum((1 << len(s)) - 1 for _, s in own)
                sums = np.zeros((most.bit_length(), -(-len(ids) // 64)), np.uint64)
                for words, slices in own:
                    add(sums, words, slices)
                found.extend((query, ids[p], s) for p, s in zip(*(x.tolist() for x in largest(sums, k))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:  # the next block
                    yield from searched(ids, terms)
                    ids, terms = row["ids"], {}
                elif row["term"] in wanted:
                    words = np.frombuffer(row["places"], np.uint32)
                    terms[row["term"]] = words, np.frombuffer(row["slices"], np.uint64).reshape(row["n_bits"], len(words))
        yield from searched(ids, terms)

    return run


def impact_search(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` documents of highest score above 0 for each row of ``items``, equal scores by ascending id.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact on a
    document the weight times (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L.

    Defined cases: null and empty texts have no terms, so such documents are not
    counted and such items find nothing; texts of any length are taken whole; rows
    that repeat an id are documents (or items) of their own, ranked one after the
    other; a row without an id is found like others, after equal ones with an id;
    other columns are not looked at, whatever their names; an empty table on
    either side gives no rows. Numbers beyond 64 bits raise under Spark's ANSI mode.
    """
    item_type = items.schema[item_col].dataType.simpleString()
    wanted = items.select(F.col(item_col).alias("item"), terms_of(F.col(item_text_col)).alias("terms")).where(F.size("terms") > 0)
    wanted = settle(wanted.withColumn("query", F.monotonically_increasing_id()))
    index = impact_index(docs, wanted.select(F.explode("terms").alias("term")).distinct(), id_col=id_col, text_col=text_col)
    size = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_TERMS))
    found = None
    for batch in range(batches):  # each is of bounded size, and sees every block
        rows = wanted.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == batch).select("query", "terms").collect()
        part = index.mapInArrow(_search([(r["query"], r["terms"]) for r in rows], k), "query long, id long, score long")
        found = part if found is None else found.unionAll(part)
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    best = best.join(wanted.select("query", "item"), "query")
    return best.select(F.col("item").cast(item_type).alias(item_col), "rank", F.col("id").alias(id_col), "score")
