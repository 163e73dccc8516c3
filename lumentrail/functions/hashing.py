"""Content and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def halves(hex16: Column) -> tuple[Column, Column]:
    """A 64-bit hash of 16 hex digits as two longs of 32 bits, so that no sign gets in the way."""
    return F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long")


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))
