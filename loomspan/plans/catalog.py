"""Queries over catalogues: includes, trees, reloads, overrides, listings, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog
from .base import PACKETS, packets, query, table


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS parent, (n_nationkey * 7 + 3) % 25 AS child FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation),
w AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT child::BIGINT, level + 1 FROM w JOIN e ON parent = node WHERE level < (SELECT count(*) FROM nation))
SELECT node::BIGINT AS node, min(level)::INT AS level FROM w GROUP BY node"""
)
def include_closure(spark: SparkSession, d: str) -> DataFrame:
    """What a root configuration includes, through cycles."""
    n = F.col("n_nationkey").cast("long")
    t = table(spark, d, "nation")
    edges = t.select(n.alias("parent"), ((n * 7 + 3) % 25).alias("child")).union(t.select(n, (n * 3 + 1) % 25))
    return catalog.include_closure(spark, edges, 0)


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def distinct_includes(spark: SparkSession, d: str) -> DataFrame:
    """Different canonical paths of a list."""
    return table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).distinct()


@query("SELECT DISTINCT 'c' || c_nationkey AS dir FROM customer UNION SELECT DISTINCT 's' || s_nationkey FROM supplier")
def watched_dirs(spark: SparkSession, d: str) -> DataFrame:
    """The union of folders to watch."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("dir"))
    return c.union(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")))).distinct()


_OLD, _NEW = "o_orderkey % 7 <> 0", "o_orderkey % 5 <> 0"


@query(
    f"""WITH o AS (SELECT o_orderkey, o_custkey AS v FROM orders WHERE {_OLD}), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS v FROM orders WHERE {_NEW})
SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN o.v = n.v THEN 'same' ELSE 'updated' END AS status
  FROM o FULL JOIN n USING (o_orderkey)) WHERE status <> 'same'"""
)
def reload_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a reload adds, removes and updates."""
    t = table(spark, d, "orders")
    new = t.filter(_NEW).withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return catalog.snapshot_diff(t.filter(_OLD), new, "o_orderkey", ["o_custkey"])


@query(f"WITH o AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE {_OLD}), n AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE {_NEW}) SELECT o_custkey, count(*) FILTER (WHERE a = 0)::BIGINT AS added, count(*) FILTER (WHERE b = 0)::BIGINT AS removed FROM (SELECT o_custkey, o_orderkey, max(w) AS a, max(i) AS b FROM (SELECT *, 1 AS w, 0 AS i FROM o UNION ALL SELECT *, 0, 1 FROM n) GROUP BY 1, 2) GROUP BY o_custkey HAVING min(a) = 0 OR min(b) = 0")
def tree_merge(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose time changes as a direct child came or went."""
    t = table(spark, d, "orders")
    return catalog.changed_folders(t.filter(_OLD), t.filter(_NEW), "o_custkey", "o_orderkey")


_PATHS = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE p_brand || '/' || p_size || '/' || (p_partkey % 50) END AS path FROM part)"


@query(
    f"""WITH {_PATHS}, f AS (SELECT DISTINCT split_part(path, '/', 1) AS path FROM p WHERE path LIKE '%/%' UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE path LIKE '%/%'),
c AS (SELECT path, min(p_partkey) AS first FROM p GROUP BY path)
SELECT p_partkey, p.path, CASE WHEN f.path IS NOT NULL THEN 'folder' WHEN p_partkey > first THEN 'duplicate' ELSE 'ok' END AS status FROM p JOIN c USING (path) LEFT JOIN f USING (path)"""
)
def tree_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Files that claim a path twice, or a folder's."""
    long = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string"))
    path = F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).otherwise(long)
    return catalog.tree_conflicts(table(spark, d, "part").select("p_partkey", path.alias("path")), "p_partkey", "path")


@query(f"SELECT status, count(*)::BIGINT AS n, CASE status WHEN 'ok' THEN 'OK' WHEN 'duplicate' THEN 'WARN' ELSE 'ERR' END AS level FROM (WITH {_PATHS}, f AS (SELECT DISTINCT split_part(path, '/', 1) AS path FROM p WHERE path LIKE '%/%' UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE path LIKE '%/%'), c AS (SELECT path, min(p_partkey) AS first FROM p GROUP BY path) SELECT CASE WHEN f.path IS NOT NULL THEN 'folder' WHEN p_partkey > first THEN 'duplicate' ELSE 'ok' END AS status FROM p JOIN c USING (path) LEFT JOIN f USING (path)) GROUP BY status")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a validation by level."""
    level = F.when(F.col("status") == "ok", "OK").when(F.col("status") == "duplicate", "WARN").otherwise("ERR")
    return tree_conflicts(spark, d).groupBy("status").agg(F.count("*").alias("n")).withColumn("level", level)


@query("SELECT l_suppkey, count(*)::BIGINT AS affected, min(l_orderkey) AS first, max(l_orderkey) AS last FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY l_suppkey")
def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    """For each source, the files that use it."""
    return catalog.affected_by(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query(
    """WITH l AS (SELECT o_orderkey, o_custkey AS size, o_custkey % 97 AS checksum FROM orders), f AS (SELECT o_orderkey, o_custkey + (CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS size, o_custkey % 97 + (CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS checksum FROM orders WHERE o_orderkey % 11 <> 0)
SELECT l.o_orderkey, CASE WHEN f.o_orderkey IS NULL THEN 'missing' WHEN l.size <> f.size THEN 'size' WHEN l.checksum <> f.checksum THEN 'checksum' ELSE 'ok' END AS status FROM l LEFT JOIN f USING (o_orderkey)"""
)
def source_check(spark: SparkSession, d: str) -> DataFrame:
    """Listed files against those that are there."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, d, "orders")
    listed = t.select("o_orderkey", c.alias("size"), (c % 97).alias("checksum"))
    found = t.filter("o_orderkey % 11 <> 0").select("o_orderkey", (c + (k % 13 == 0).cast("int")).alias("size"), (c % 97 + (k % 17 == 0).cast("int")).alias("checksum"))
    return catalog.listing_check(listed, found, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def stale_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Overrides whose path is gone."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS uid, CASE WHEN c_custkey % 3 = 0 THEN 493 END AS mode FROM customer WHERE c_acctbal < 5000)
SELECT c.c_custkey, coalesce(o.uid, 1000)::INT AS uid, coalesce(o.mode, 292)::INT AS mode FROM customer c LEFT JOIN o USING (c_custkey)"""
)
def permission_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Owners and modes: the override where set, else the default."""
    t = table(spark, d, "customer")
    uid, mode = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 3 == 0, F.lit(493))
    return catalog.resolve(t, t.filter("c_acctbal < 5000").select("c_custkey", uid.alias("uid"), mode.alias("mode")), "c_custkey", {"uid": F.lit(1000), "mode": F.lit(292)})


@query(f"WITH {PACKETS} SELECT stream, min(CASE WHEN stream % 9 = 0 AND seq = 2 THEN seq END) AS first_difference, count(*)::BIGINT AS chunks FROM packets GROUP BY stream")
def verify_equal(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk where an original and its reconstruction differ."""
    a = packets(spark, d)
    b = a.withColumn("size", F.col("size") + ((F.col("stream") % 9 == 0) & (F.col("seq") == 2)).cast("int"))
    return catalog.first_difference(a, b, ["stream"], "seq", "size")


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS codecs FROM customer GROUP BY c_nationkey")
def codec_union(spark: SparkSession, d: str) -> DataFrame:
    """Different values of several lists, as one."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("codecs"))


@query("SELECT c_nationkey, row_number() OVER (ORDER BY first)::INT AS place, n, first FROM (SELECT c_nationkey, min(c_custkey) AS first, count(*)::BIGINT AS n FROM customer GROUP BY c_nationkey)")
def group_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order in which they are first seen."""
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("first")))  # a row a group


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS ok, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS skipped, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS failed, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::INT AS exit_code FROM orders")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of a batch and its exit code."""
    is_ = lambda s: F.col("o_orderstatus") == s
    return table(spark, d, "orders").agg(F.count_if(is_("F")).alias("ok"), F.count_if(is_("O")).alias("skipped"), F.count_if(is_("P")).alias("failed"), F.max(is_("P").cast("int")).alias("exit_code"))


@query("SELECT o_orderpriority AS source, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ', ') AS files, count(*)::BIGINT AS n FROM orders GROUP BY o_orderpriority")
def event_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of events as one line a source."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ", ").alias("files"), F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS entries, count(DISTINCT l_orderkey)::BIGINT AS targets, count(DISTINCT l_suppkey)::BIGINT AS sources, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem")
def info(spark: SparkSession, d: str) -> DataFrame:
    """A header in one row."""
    return table(spark, d, "lineitem").agg(F.count("*").alias("entries"), F.countDistinct("l_orderkey").alias("targets"), F.countDistinct("l_suppkey").alias("sources"), F.sum(F.col("l_quantity").cast("long")).alias("size"))


@query("SELECT p_brand, md5(string_agg(md5(p_name), '' ORDER BY p_partkey)) AS digest, count(*)::BIGINT AS chunks FROM part GROUP BY p_brand")
def chunk_checksums(spark: SparkSession, d: str) -> DataFrame:
    """A checksum of a file from those of its chunks, in order."""
    chunk = F.struct("p_partkey", F.md5("p_name").alias("h"))
    g = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    return g.select("p_brand", F.md5(F.array_join(F.col("c.h"), "")).alias("digest"), F.size("c").cast("long").alias("chunks"))
