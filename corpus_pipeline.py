"""A corpus pipeline: toxicity, line dedup, near duplicates, mixing and packing.

Each stage takes what its predecessor kept and its decisions take effect: toxic
documents go, shared lines go, one document of each group of near copies stays,
the mix repeats or leaves out documents, and the rest is packed.

Defined cases, in every stage: a null or empty text is a document like another
(not toxic without a learned reason, one empty line, no near copy, no words for
the mix, the end id alone when packed); texts of any length are taken whole; rows
that repeat an id are rows of their own, treated alike where their texts are; rows
without an id pass, and are mixed by their texts; columns beside those of
documents are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.llm.common import bucket_of, hashed, settle, table
from lumentrail.llm.line_dedup import line_dedup
from lumentrail.llm.mixing import mix_sources
from lumentrail.llm.ngram_join import ngram_join
from lumentrail.llm.registry import pack_public
from lumentrail.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document scoring this or more is rejected.
TOXIC_FROM = 0.7


def _measured(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the text as it is now, in the columns of documents."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under ``TOXIC_FROM``; the model learns from the rows that op7 learns from (its fixed prior, where they are none)."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 3) != 1))
    return score_toxicity(docs, model).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with two others; a document may end without text."""
    return _measured(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows that repeat that id all stay, as do rows without an id."""
    kept = settle(ngram_join(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(hashed(kept, kept.count()), "doc_id", "left_semi")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix at weights 5, 2, 1 over the sources takes them; the one at a source's cut counts as whole if at least half is taken."""
    # Rows without an id go by their texts: no key is all of them.
    docs = docs.select(*COLUMNS).withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    taken = mix_sources(docs, F.array("source"), id_col="__key").groupBy(F.col("doc_id").alias("__key")).agg(F.max(times).alias("__times"))  # rows that repeat an id go alike
    taken = settle(taken.where("__times > 0"))
    mixed = docs.join(hashed(taken, taken.count()), "__key")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, in sequences of 2048 ids; of a document taken twice, those of each copy."""
    return pack_public(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned scores, seeded draws by md5 and byte-pair ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are settled for the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
