"""Table functions for SQL: one in SQL, one in Python whose columns follow its arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class FrameTimes:
    """``frame_times(duration_ms, most, with_clock)``: frames in the middle of equal parts of a video; ``with_clock``, a literal, adds the time as m:ss."""

    @staticmethod
    def analyze(duration_ms: AnalyzeArgument, most: AnalyzeArgument, with_clock: AnalyzeArgument) -> AnalyzeResult:
        if not with_clock.isConstantExpression:
            raise ValueError("with_clock must be a literal: columns depend on it")
        schema = StructType().add("frame", IntegerType()).add("ts_ms", LongType())
        return AnalyzeResult(schema.add("clock", StringType()) if with_clock.value else schema)

    def eval(self, duration_ms: int | None, most: int, with_clock: bool) -> Iterator[tuple]:
        if duration_ms is None or duration_ms <= 0:
            return
        n = max(1, min(most, duration_ms // 1000))
        part = duration_ms // n
        for i in range(n):
            at = i * part + part // 2
            yield (i, at, f"{at // 60_000}:{at // 1000 % 60:02d}") if with_clock else (i, at)


def register(spark: SparkSession) -> None:
    """``sample_times(duration_ms, most)`` in SQL, a table of ``frame, ts_ms``, and ``frame_times``, for lateral joins with videos."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION sample_times(duration_ms BIGINT, most INT) RETURNS TABLE (frame INT, ts_ms BIGINT) RETURN
        SELECT i, CAST(i * (duration_ms DIV n) + (duration_ms DIV n) DIV 2 AS BIGINT)
        FROM (SELECT GREATEST(1, LEAST(most, duration_ms DIV 1000)) AS n) LATERAL VIEW EXPLODE(SEQUENCE(0, CAST(n AS INT) - 1)) AS i
        WHERE duration_ms > 0
    """)
    spark.udtf.register("frame_times", udtf(FrameTimes))
