"""Queries that need a run over bytes, and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, checksums
from ..operators import gapfill
from .base import query, table


@query()
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Texts with two bytes put in after every 40 characters, found again in the texts as they were; null text has no rows."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    wide = F.regexp_replace("text", "(?s)(.{40})", "$1~~")
    return gapfill.fill_gaps(t.select("doc_id", F.lit(0).alias("gap_s"), F.lit(0).alias("source_s"), F.encode(wide, "UTF-8").alias("target"), F.encode("text", "UTF-8").alias("source")), "doc_id")


@query()
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """XXH64 of each source's documents, as one file in chunks."""
    t = table(spark, d, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("chunk"))
    return checksums.file_checksums(t, "source", "doc_id", "chunk")


@query(
    """WITH a AS (SELECT c_custkey, c_custkey % 4 AS caller, c_nationkey % 4 AS owner, c_nationkey % 3 AS grp, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 END AS no, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 END AS ng FROM customer)
SELECT c_custkey, caller = 0 OR ((no IS NULL OR no = owner) AND (ng IS NULL OR ng = grp OR (caller = owner AND ng IN (1, caller)))) AS chown, caller = 0 OR caller = owner AS chmod FROM a"""
)
def access_rules(spark: SparkSession, d: str) -> DataFrame:
    """Who may change an owner or a mode."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    caller, owner = k % 4, n % 4
    groups = F.array(F.lit(1).cast("long"), caller)
    chown = access.may_chown(caller, groups, owner, n % 3, F.when(k % 5 == 0, k % 4), F.when(k % 2 == 0, k % 3))
    return table(spark, d, "customer").select("c_custkey", chown.alias("chown"), access.may_chmod(caller, owner).alias("chmod"))
