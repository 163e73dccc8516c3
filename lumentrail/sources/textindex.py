"""A stored inverted index for containment search.

A word of a query has no white space, so a text contains it if one of the text's own
words does. The index is two Parquet tables: the distinct words, and for each word the
ids of its texts in blocks; both are partitioned by a hash of the word. A search
scans the words (far fewer than texts), and reads postings of the partitions and words
that it found, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.operators.lineage import settle

#: Ids of a postings row at most, and words found up to which their names go to the scan as a filter.
BLOCK, NAMED = 8_192, 1_000
#: Tasks that write a bucket's postings.
PARTS = 8


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case, split at ASCII white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")), "")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of up to ``BLOCK`` texts at a time, each with the ids of its texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            words = pc.list_flatten(batch.column("words")).dictionary_encode()
            codes, rows = words.indices.to_numpy(), pc.list_parent_indices(batch.column("words")).to_numpy()
            turn = np.empty(batch.num_rows, np.int64)
            turn[pc.array_sort_indices(batch.column("key")).to_numpy()] = np.arange(batch.num_rows)
            order = np.lexsort((turn[rows], codes))
            codes = codes[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), batch.column("key").take(pa.array(rows[order])))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes[starts])), ids], ["word", "ids"])


def write_index(texts: DataFrame, path: str, *, key: str = "media_id", text: str = "text", buckets: int = 64) -> None:
    """Writes the index of ``texts`` to ``path``. Postings are made where the texts are read, so that a word and its ids travel together, and a common word has a row for each ``BLOCK`` of texts."""
    spark, bucket = texts.sparkSession, F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    held = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    made = held.mapInArrow(_postings, f"word string, ids array<{texts.schema[key].dataType.simpleString()}>")
    part = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(PARTS))
    made = made.select(bucket.alias("bucket"), "word", F.array_distinct("ids").alias("ids"))
    made.repartition("bucket", part).sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").groupBy("bucket", "word").agg(F.sum(F.size("ids")).alias("n"))
    sizes.repartition("bucket").sortWithinPartitions("word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/words")


def found_postings(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """``token, word, ids``: the postings of every word that contains one of ``tokens``.

    Up to ``NAMED`` words, the scan is told their partitions and names; more are
    joined, with their partitions pruned as Spark finds them.
    """
    words = spark.read.parquet(f"{path}/words")
    asked = F.array(*(F.when(F.contains("word", F.lit(t)), F.lit(t)) for t in dict.fromkeys(x.lower() for x in tokens)))
    hits = settle(words.where(F.exists(asked, lambda t: t.isNotNull())).select("bucket", "word", F.explode(F.array_compact(asked)).alias("token")))
    postings = spark.read.parquet(f"{path}/postings")
    names = hits.select("bucket", "word").distinct().limit(NAMED + 1).collect()
    if len(names) <= NAMED:
        postings = postings.where(F.col("bucket").isin([r["bucket"] for r in names]) & F.col("word").isin([r["word"] for r in names]))
    return postings.join(hits, ["bucket", "word"]).select("token", "word", "ids")


def indexed_scores(spark: SparkSession, path: str, query: str, *, key: str = "media_id") -> DataFrame:
    """``media_id, text_score`` as ``text_scores`` gives them: the share of the query's words that a text contains; texts with none are left out."""
    tokens = query.lower().split()
    if not tokens:
        return found_postings(spark, path, ["\n"]).select(F.explode("ids").alias(key), F.lit(0.0).alias("text_score"))
    times = F.create_map(*(F.lit(x) for t in dict.fromkeys(tokens) for x in (t, tokens.count(t))))
    once = found_postings(spark, path, tokens).select("token", F.explode("ids").alias(key)).distinct()
    return once.groupBy(key).agg((F.sum(times[F.col("token")]).cast("double") / len(tokens)).alias("text_score"))
