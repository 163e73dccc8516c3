"""What the corpus operators share: table access, lineage cuts and small text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.operators.lineage import settle

__all__ = ["ASCII_LOWER", "HASHED_ROWS", "SPACE", "WORD", "ascii_lower", "bucket_of", "hashed", "settle", "table", "tokenizer_file"]

#: The white space of every word and line rule here.
SPACE = " \t\n\x0b\x0c\r"
#: A word, for Python and Java regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-casing of A-Z alone.
ASCII_LOWER = {u: u + 32 for u in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition up to which a hash table of short keys is built for a join: such a table can't spill.
HASHED_ROWS = 2_000_000


def hashed(small: DataFrame, rows: int) -> DataFrame:
    """``small`` (``rows`` rows at most) as the side of a join whose keys are hashed, so that the other side, with its texts, need not be sorted.

    Only where a partition's share of it is small; else the join sorts, and spills.
    """
    partitions = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.hint("shuffle_hash") if rows <= HASHED_ROWS * partitions else small


def ascii_lower(text: str) -> str:
    """``text`` with A-Z lower-cased and everything else as it is."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def bucket_of(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a row."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
