"""Catalogue operators: include graphs, trees, snapshots, overrides, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base


def include_closure(spark: SparkSession, edges: DataFrame, root: int) -> DataFrame:
    """Nodes that `root` reaches by edges (parent, child), with their least distance, however deep.

    One level after another: what the last one includes and no level before had.  Cycles and
    shared includes end there, so the work is that of each edge once.
    """
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    edges = edges.select("parent", F.col("child").alias("node")).filter("node IS NOT NULL")
    seen = last = spark.createDataFrame([(root, 0)], "node long, level int")
    level = 0
    while True:
        level += 1
        met = edges.join(last.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()
        last = met.join(seen, "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Names that are added, removed or updated between two snapshots."""
    o = old.select(key, F.struct(*values).alias("o"))
    n = new.select(key, F.struct(*values).alias("n"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, status.alias("status")).filter("status <> 'same'")


def changed_folders(old: DataFrame, new: DataFrame, parent: str, child: str) -> DataFrame:
    """Folders that gained or lost a direct child, with how many."""
    o = old.select(parent, child).distinct().withColumn("was", F.lit(True))
    n = new.select(parent, child).distinct().withColumn("is", F.lit(True))
    both = o.join(n, [parent, child], "full_outer")
    out = both.groupBy(parent).agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"))
    return out.filter("added + removed > 0")


def tree_conflicts(files: DataFrame, order: str, path: str) -> DataFrame:
    """Each file's standing in the tree: ok, duplicate (of an earlier one) or folder (of another)."""
    claims = files.groupBy(path).agg(F.min(order).alias("first"))
    parts = F.split(path, "/")
    folders = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias(path)).filter(f"{path} <> ''").distinct().withColumn("is_folder", F.lit(True))
    out = files.join(claims, path).join(folders, path, "left")
    status = F.when(F.col("is_folder"), "folder").when(F.col(order) > F.col("first"), "duplicate").otherwise("ok")
    return out.select(order, path, status.alias("status"))


def listing_check(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """listed (key, size, checksum) against what is there: missing, size, checksum or ok."""
    f = found.select(key, F.col("size").alias("f_size"), F.col("checksum").alias("f_checksum"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("size") != F.col("f_size"), "size").when(F.col("checksum") != F.col("f_checksum"), "checksum").otherwise("ok")
    return listed.join(f, key, "left").select(key, status.alias("status"))


def resolve(rows: DataFrame, overrides: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Columns from overrides where set, else their defaults."""
    o = overrides.select(key, *[F.col(c).alias(f"o_{c}") for c in columns])
    return rows.join(o, key, "left").select(key, *[F.coalesce(F.col(f"o_{c}"), default).alias(c) for c, default in columns.items()])


def first_difference(a: DataFrame, b: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """For each key, the first place where two chunked copies differ; null where they are equal."""
    both = a.select(*key, at, F.col(value).alias("x")).join(b.select(*key, at, F.col(value).alias("y")), [*key, at], "full_outer")
    return both.groupBy(*key).agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col(at))).alias("first_difference"), F.count("*").alias("chunks"))


def affected_by(files: DataFrame, source: str, name: str) -> DataFrame:
    """The reverse index: for each source, how many files use it, and the first and last of them."""
    f = files.select(source, name).distinct()
    return f.groupBy(source).agg(F.count("*").alias("affected"), F.min(name).alias("first"), F.max(name).alias("last"))
