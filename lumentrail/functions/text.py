"""Text and sets of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_query(q: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def escaped_like(needle: str) -> str:
    """A literal for LIKE with its wildcards escaped."""
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_folded(text: Column, needle: str) -> Column:
    """Case-insensitive containment of a literal (wildcards have no meaning)."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def token_overlap(text: Column, tokens: list[str]) -> Column:
    """Share of the tokens that a text contains; 0 without tokens."""
    if not tokens:
        return F.lit(0.0)
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("double") for t in tokens), F.lit(0.0)) / len(tokens)


def label_in_query(label: Column, tokens: list[str]) -> Column:
    """Whether every word of a label is among the query's, as it is or with an s."""
    known = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    return F.forall(F.split(F.lower(label), " "), lambda w: F.array_contains(known, w) | F.array_contains(known, F.concat(w, F.lit("s"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def split_list(joined: Column) -> Column:
    """A comma-joined list as an array, without empty entries."""
    return F.filter(F.transform(F.split(joined, ","), lambda x: F.trim(x)), lambda x: x != "")


def byte_size(n: Column) -> Column:
    """Bytes for people."""
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / float(1024**2))).otherwise(F.format_string("%.1f GB", n / float(1024**3)))
    )
