"""The register of queries, and SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packets of a stream per order: seq from 0, size, track, file."""
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream"),
        (F.row_number().over(by) - 1).cast("long").alias("seq"),
        F.col("l_quantity").cast("long").alias("size"),
        (F.col("l_suppkey") % 3).alias("track"),
        (F.col("l_partkey") % 5).alias("file"),
        F.col("l_returnflag").alias("flag"),
    )


PACKETS = f"""packets AS (
  SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS seq,
         l_quantity::BIGINT AS size, l_suppkey % 3 AS track, l_partkey % 5 AS file, l_returnflag AS flag
  FROM lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as matched regions of a target per order, many of them overlapping."""
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    s = (F.col("l_partkey") * 7 % 120).alias("s")
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("target"),
        s,
        (F.col("l_partkey") * 7 % 120 + F.col("l_quantity").cast("long")).alias("e"),
        (F.col("l_suppkey") % 2).alias("file"),
        (F.col("l_partkey") * 7 % 120 + F.col("l_suppkey") % 2 * 1000).alias("src"),
        (F.col("l_returnflag") == "N").alias("is_video"),
        (F.row_number().over(by) - 1).cast("long").alias("ord"),
    )
    return r


REGIONS = f"""regions AS (
  SELECT l_orderkey AS target, l_partkey * 7 % 120 AS s, l_partkey * 7 % 120 + l_quantity::BIGINT AS e, l_suppkey % 2 AS file,
         l_partkey * 7 % 120 + l_suppkey % 2 * 1000 AS src, l_returnflag = 'N' AS is_video,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS ord
  FROM lineitem)"""


def sql_merge(rows: str, key: str, identity: str, order: str) -> str:
    """CTEs m1, m2, m3 and merged (key, s, e, identity, src) of `rows`."""
    same = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in [*identity.split(", "), "dg"])
    return f"""m1 AS (
  SELECT *, src - s AS dg, max(e) OVER (PARTITION BY {key} ORDER BY s, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {rows}),
m2 AS (
  SELECT *, CASE WHEN coalesce(s < pm, FALSE) AND {same} THEN 0 ELSE 1 END AS fresh
  FROM m1 WHERE pm IS NULL OR e > pm WINDOW w AS (PARTITION BY {key} ORDER BY s, {order})),
m3 AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY s, {order} ROWS UNBOUNDED PRECEDING) AS g FROM m2),
merged AS (
  SELECT {key}, min(greatest(s, coalesce(pm, s))) AS s, max(e) AS e, {identity}, min(greatest(s, coalesce(pm, s))) + dg AS src
  FROM m3 GROUP BY {key}, g, {identity}, dg)"""


def sql_complement(rows: str, sizes: str, key: str) -> str:
    """CTEs c1 to c3 and entries (key, mkv_offset, length, source, source_offset)."""
    return f"""c1 AS (
  SELECT {key}, s, e, file, src, FALSE AS tail FROM {rows}
  UNION ALL SELECT {key}, size, size, NULL, NULL, TRUE FROM {sizes}),
c2 AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s, tail), 0) AS frm FROM c1),
c3 AS (
  SELECT {key}, frm AS mkv_offset, s - frm AS length, 0 AS source, NULL AS so FROM c2 WHERE s > frm
  UNION ALL SELECT {key}, s, e - s, file + 1, src FROM c2 WHERE NOT tail),
entries AS (
  SELECT {key}, mkv_offset::BIGINT AS mkv_offset, length::BIGINT AS length, source::BIGINT AS source,
    CASE WHEN source > 0 THEN so ELSE coalesce(sum(CASE WHEN source = 0 THEN length END)
      OVER (PARTITION BY {key} ORDER BY mkv_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS source_offset
  FROM c3)"""
