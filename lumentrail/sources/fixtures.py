"""The media catalog as views over the driver's tables.

Every view is a list of expressions that Spark and DuckDB read alike, so that a
query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View: (table, columns, condition).
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "media": (
        "orders",
        [
            "o_orderkey AS media_id",
            "o_custkey AS person_id",
            "o_orderdate AS created",
            "o_orderpriority AS album",
            "CASE WHEN o_orderstatus = 'P' THEN 'video' ELSE 'photo' END AS kind",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / CAST(500000 AS DOUBLE) END AS quality",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS blur",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey * 7919 % 1200 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(60 AS DOUBLE) END AS lat",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey * 104729 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) END AS lng",
            "CAST(o_orderkey * 1013 % 5000000 AS BIGINT) AS bytes",
            "CAST(o_orderkey % 1024 AS BIGINT) AS stages",
            "CAST(o_orderkey % 40 AS BIGINT) AS views",
            "CAST(1000 + o_orderkey % 7 * 300 AS BIGINT) AS width",
            "CAST(1500 AS BIGINT) AS height",
        ],
        None,
    ),
    "tags": ("lineitem", ["l_orderkey * 10 + l_linenumber AS tag_id", "l_orderkey AS media_id", "concat(l_returnflag, l_linestatus) AS label", "l_discount * CAST(10 AS DOUBLE) AS confidence"], None),
    "favorites": ("orders", ["o_orderkey AS media_id"], "o_orderkey % 13 = 0"),
    "trash": ("orders", ["o_orderkey AS media_id", "o_orderdate AS deleted"], "o_orderkey % 29 = 0"),
    "hidden": ("orders", ["o_orderkey AS media_id"], "o_orderkey % 31 = 0"),
    "faces": ("lineitem", ["l_orderkey * 10 + l_linenumber AS face_id", "l_orderkey AS media_id", "l_suppkey AS person_id", "l_discount * CAST(10 AS DOUBLE) AS confidence"], None),
    "people": ("supplier", ["s_suppkey AS person_id", "s_name AS name", "CASE WHEN s_nationkey % 4 = 0 THEN 'merged' ELSE 'active' END AS status", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS display_name"], None),
    "timeline": ("events", ["event_id AS media_id", "user_id AS owner", "ts", "event_type AS kind", "value"], None),
    "moments": (
        "events",
        [
            "event_id AS media_id",
            "user_id AS owner",
            "ts AS created",
            "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id % 80 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) * (CASE WHEN user_id % 3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END) END AS lat",
            "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id % 170 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) * CAST(0.004 AS DOUBLE) END AS lng",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id * 31 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS quality",
            "event_id % 4 = 0 AS has_people",
            "event_id % 23 AS person_id",
        ],
        None,
    ),
    "vectors": ("embeddings", ["vec_id AS media_id", "embedding AS vector", "label AS region"], None),
    "texts": ("documents", ["doc_id AS media_id", "text", "lang", "source"], None),
    "states": ("labels", ["doc_id AS media_id", "quality AS is_good", "toxic AS is_flagged"], None),
    "turns": ("conversations", ["conv_id", "turn", "role", "text"], None),
    "segments": (
        "lineitem",
        [
            "l_orderkey AS video_id",
            "CAST(l_linenumber AS BIGINT) * 4000 - 4000 AS start_ms",
            "CAST(l_linenumber AS BIGINT) * 4000 - 4000 + CAST(l_quantity AS BIGINT) * 150 AS end_ms",
            "concat(l_returnflag, l_linestatus) AS label",
            "l_suppkey AS person_id",
            "l_discount * CAST(10 AS DOUBLE) AS confidence",
            "l_extendedprice AS score",
        ],
        None,
    ),
    "jobs": (
        "events",
        [
            "event_id AS job_id",
            "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END AS status",
            "CAST(event_id % 4 AS BIGINT) AS priority",
            "ts AS created",
            "ts AS started",
            "user_id AS media_id",
            "CAST(event_id % 5 AS BIGINT) AS retries",
        ],
        None,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame: only the columns it names are read."""
    table, columns, condition = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (rows.where(condition) if condition else rows).selectExpr(*columns)


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB in which the views are defined."""
    parts = []
    for name in names:
        table, columns, condition = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table}{f' WHERE {condition}' if condition else ''})")
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE ")
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts)
    if sql.upper().startswith("WITH "):
        return f"{head}, {sql[15:] if recursive else sql[5:]}"
    return f"{head} {sql}"
