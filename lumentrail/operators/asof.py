"""As-of joins: each row with the nearest row of another table before or after it, from sorts alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrail.operators.lineage import spread, tasks


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, *, forward: bool = False, equal: bool = True, span: int = 3_600_000) -> DataFrame:
    """``left`` with ``s``: the row of ``right`` (its columns beside ``by``, as a struct) that is last by ``right_at`` up to ``at``.

    ``forward``: the first from ``at`` on. ``equal``: the same time counts. Null where
    there is none. Rows of ``right`` must not repeat a time within ``by``.

    Times are numbers. Both tables are put together and sorted within stretches of
    ``span``, and what a stretch begins with comes from a window over one row a stretch;
    so a key with most of the rows is sorted by as many tasks as it has stretches.
    """
    by, sign = list(by), -1 if forward else 1
    held = F.struct(*[F.col(c) for c in right.columns if c not in by])
    mark = lambda c: F.col(c) * sign
    own = left.select(*by, mark(at).alias("__t"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__right"))
    other = right.select(*by, mark(right_at).alias("__t"), F.lit(None).cast(own.schema["__left"].dataType).alias("__left"), held.alias("__right"))
    both = own.unionAll(other)
    n = tasks(both)
    both = spread(both.withColumn("__span", F.floor(F.col("__t") / span)), *by, "__span", n=n)
    # At one time the rows of right come first if they count, else last.
    turn = F.col("__left").isNotNull() if equal else F.col("__left").isNull()
    near = F.last("__right", ignorenulls=True).over(Window.partitionBy(*by, "__span").orderBy("__t", turn).rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(*by, "__span").agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__t"))).alias("__end"))
    start = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = spread(spread(ends, *by, n=n).select(*by, "__span", start.alias("__start")), *by, "__span", n=n)
    local = both.withColumn("s", near).where("__left is not null")
    return local.join(starts, [*by, "__span"]).select("__left.*", F.coalesce("s", "__start").alias("s"))


def max_before(df: DataFrame, by: Sequence[str], at: str, value: str, *, span: int = 3_600_000) -> DataFrame:
    """``df`` with ``before``: the largest ``value`` of the rows before each by ``at``, then ``value``; null for the first. In stretches, as ``asof``."""
    by, n = list(by), tasks(df)
    rows = spread(df.withColumn("__span", F.floor(F.col(at) / span)), *by, "__span", n=n)
    local = F.max(value).over(Window.partitionBy(*by, "__span").orderBy(at, value).rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(*by, "__span").agg(F.max(value).alias("__end"))
    start = F.max("__end").over(Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = spread(spread(ends, *by, n=n).select(*by, "__span", start.alias("__start")), *by, "__span", n=n)
    return rows.withColumn("__local", local).join(starts, [*by, "__span"]).select(*df.columns, F.greatest("__local", "__start").alias("before"))
