"""Connected components of a table of links, by hooking and contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b), longs, a table that is cheap to read twice -> node, root: the smallest node that it reaches.

    Every round, a node hooks onto the smallest of its neighbours and itself, parents are
    followed twice, and the links are rewritten to parents; those within a tree go.  Links
    and parents stay in tables of the shared folder; the driver sees their count alone.
    """
    both = lambda x: x.select(F.col("a").alias("node"), F.col("b").alias("other")).union(x.select("b", "a"))
    hook = lambda x: both(x).groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
    links = links.filter("a <> b")
    roots = save(spark, _jump(hook(links)), "cc-roots")
    while True:
        at = lambda x, c: x.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")  # noqa: B023, E731
        links = save(spark, at(at(links, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
        if links.isEmpty():
            break
        higher = _jump(hook(links)).select(F.col("node").alias("root"), F.col("root").alias("higher"))
        roots = save(spark, roots.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "cc-roots")
    while True:
        # Parents that aren't roots themselves remain only where a chain was longer than the jumps.
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher")).filter("root <> higher")
        if roots.join(up, "root", "left_semi").isEmpty():
            return roots
        roots = save(spark, roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "cc-roots")


def _jump(tree: DataFrame) -> DataFrame:
    up = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return tree.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
