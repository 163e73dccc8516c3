"""Vector arithmetic as Catalyst expressions: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where sizes differ or a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths).otherwise(0.0)


def clamped_dot(a: Column, b: Column) -> Column:
    """Similarity of unit vectors, held within -1 and 1; 0 where sizes differ."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, held within 0 and 1; 1 where sizes differ or a vector has no length."""
    lengths = norm(a) * norm(b)
    distance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(a, b) / lengths))
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), distance).otherwise(1.0)


def l2_normalized(a: Column) -> Column:
    """Scaled to length 1; a vector without length stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))


def literal(values) -> Column:
    """A vector known to the driver."""
    return F.array(*[F.lit(float(v)) for v in values])
