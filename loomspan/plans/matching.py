"""Queries over texts: index, probe, match, extension, and the entries that result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import earlier, intervals, matching
from .base import query, sql_complement, sql_merge, table


def _sql_runs(target: str, key: str, earlier: str = "") -> str:
    """CTEs to runs (target, source, s, e, src) of a table's texts against documents: all maximal runs of 79 characters or more.

    Such a run holds a whole window of 64 characters that begins at a 16th of its source.
    """
    return f"""ts AS (SELECT {key} AS target, text FROM {target} WHERE length(text) >= 79),
ss AS (SELECT doc_id AS source, text FROM documents WHERE length(text) >= 79),
tw AS (SELECT target, p AS t_pos, hash(substr(text, p + 1, 64)) AS w FROM (SELECT target, text, unnest(range(0, length(text) - 63)) AS p FROM ts)),
sw AS (SELECT source, p AS s_pos, hash(substr(text, p + 1, 64)) AS w FROM (SELECT source, text, unnest(range(0, length(text) - 63, 16)) AS p FROM ss)),
dia AS (SELECT DISTINCT target, source, s_pos - t_pos AS dg0 FROM tw JOIN sw USING (w) {earlier}),
tc AS (SELECT target, string_split(text, '') AS c FROM ts WHERE target IN (SELECT target FROM dia)),
sc AS (SELECT source, string_split(text, '') AS c FROM ss WHERE source IN (SELECT source FROM dia)),
pos AS (
  SELECT target, source, dg0, p FROM (
    SELECT d.target, d.source, d.dg0, tc.c AS a, sc.c AS b, unnest(range(greatest(0, -dg0), least(len(tc.c), len(sc.c) - dg0))) AS p
    FROM dia d JOIN tc USING (target) JOIN sc USING (source)) WHERE a[p + 1] = b[p + dg0 + 1]),
isl AS (
  SELECT target, source, dg0, min(p) AS s, max(p) + 1 AS e
  FROM (SELECT *, p - row_number() OVER (PARTITION BY target, source, dg0 ORDER BY p) AS g FROM pos) GROUP BY target, source, dg0, g),
runs AS (SELECT target, source AS file, s, e, s + dg0 AS src FROM isl WHERE e - s >= 79)"""


def runs(targets: DataFrame, target: str, docs: DataFrame) -> DataFrame:
    """All maximal runs of matching.RUN characters or more that targets share with documents: target, file, s, e, src."""
    hits = matching.seeds(targets, target, docs, "doc_id")
    found = matching.extend(hits, targets, target, docs, "doc_id")
    return found.withColumnRenamed("source", "file")


def entries(found: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    merged = intervals.merge_regions(found, "target", ["file"], ["file", "src"])
    sizes = targets.select(F.col(target).alias("target"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return intervals.complement(merged, sizes, "target")


_CONTAMINATION = f"""WITH {_sql_runs("benchmark", "item_id")},
{sql_merge("runs", "target", "file", "file, src")},
sizes AS (SELECT item_id AS target, length(text)::BIGINT AS size FROM benchmark),
{sql_complement("merged", "sizes", "target")}"""


@query(_CONTAMINATION + " SELECT * FROM entries")
def contamination_entries(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark passage: which ranges are in which document, and what remains."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    return entries(runs(items, "item_id", docs), items, "item_id")


@query(
    f"""WITH {_sql_runs("documents", "doc_id", "WHERE source < target")},
{sql_merge("runs", "target", "file", "file, src")},
sizes AS (SELECT doc_id AS target, length(text)::BIGINT AS size FROM documents),
{sql_complement("merged", "sizes", "target")} SELECT * FROM entries"""
)
def document_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every document as ranges of earlier documents and a remainder."""
    docs = table(spark, d, "documents")
    found = earlier.earlier_runs(spark, docs, "doc_id").withColumnRenamed("source", "file")
    return entries(found, docs, "doc_id")


@query(
    _CONTAMINATION
    + """ SELECT count(*)::BIGINT AS n_entries, sum(CASE WHEN source > 0 THEN length ELSE 0 END)::BIGINT AS matched_bytes,
  sum(CASE WHEN source = 0 THEN length ELSE 0 END)::BIGINT AS delta_bytes,
  count(DISTINCT CASE WHEN source > 0 THEN target END)::BIGINT AS matched_targets, count(DISTINCT target)::BIGINT AS targets FROM entries"""
)
def match_totals(spark: SparkSession, d: str) -> DataFrame:
    """Matched and unmatched characters and passages."""
    hit = F.col("source") > 0
    return contamination_entries(spark, d).agg(
        F.count("*").alias("n_entries"),
        F.sum(F.when(hit, F.col("length")).otherwise(0)).alias("matched_bytes"),
        F.sum(F.when(~hit, F.col("length")).otherwise(0)).alias("delta_bytes"),
        F.countDistinct(F.when(hit, F.col("target"))).alias("matched_targets"),
        F.countDistinct("target").alias("targets"),
    )


_WINDOWS = """w AS (SELECT doc_id, p AS pos, substr(text, p + 1, 64) AS win FROM (
  SELECT doc_id, text, unnest(range(0, length(text) - 63, 64)) AS p FROM documents WHERE length(text) >= 64))"""


@query(f"WITH {_WINDOWS} SELECT doc_id, count(*)::BIGINT AS n_windows, max(pos)::BIGINT AS last_pos FROM w GROUP BY doc_id")
def stride_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sampling at a fixed stride; only windows that fit."""
    w = matching.windows(table(spark, d, "documents"), "doc_id", matching.WINDOW)
    return w.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.max("pos").alias("last_pos"))


@query(f"WITH {_WINDOWS} SELECT file, pos, n FROM (SELECT min(struct_pack(f := doc_id, p := pos)).f AS file, min(struct_pack(f := doc_id, p := pos)).p AS pos, count(*)::BIGINT AS n FROM w GROUP BY win)")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """The index: each window's first place and number of places."""
    return matching.postings(table(spark, d, "documents"), "doc_id").select("first.file", "first.pos", "n")


@query(f"WITH {_WINDOWS} SELECT n, count(*)::BIGINT AS n_windows FROM (SELECT count(*)::BIGINT AS n FROM w GROUP BY win) GROUP BY n HAVING n > 1")
def hot_windows(spark: SparkSession, d: str) -> DataFrame:
    """How many windows have how many places: the skew of the index."""
    return matching.postings(table(spark, d, "documents"), "doc_id").filter("n > 1").groupBy("n").agg(F.count("*").alias("n_windows"))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, length(text)::BIGINT AS size FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are equal as a whole."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("size"))
    return docs.groupBy("digest", "size").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "copies", "size")


_HITS = f"""{_WINDOWS},
t AS (SELECT item_id, p AS pos, substr(text, p + 1, 64) AS win FROM (SELECT item_id, text, unnest(range(0, length(text) - 63)) AS p FROM benchmark WHERE length(text) >= 64)),
c AS (SELECT item_id * 1000 + t.pos AS probe, w.doc_id AS file, w.pos AS s_pos, t.pos AS t_pos, t.pos * 3 AS hint FROM t JOIN w USING (win))"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Places of the index that benchmark windows meet."""
    t = matching.windows(table(spark, d, "benchmark"), "item_id", 1)
    w = matching.windows(table(spark, d, "documents"), "doc_id", matching.WINDOW).select(F.col("doc_id").alias("file"), F.col("pos").alias("s_pos"), "hash")
    probe, hint = (F.col("item_id") * 1000 + F.col("pos")).alias("probe"), (F.col("pos") * 3).alias("hint")
    return t.join(w, "hash").select(probe, "file", "s_pos", F.col("pos").alias("t_pos"), hint)


@query(f"WITH {_HITS} SELECT probe, file, s_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY abs(s_pos - hint), s_pos, file)::INT AS rank FROM c) WHERE rank <= 8")
def nearest_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The eight places nearest to a hint."""
    by = Window.partitionBy("probe").orderBy(F.abs(F.col("s_pos") - F.col("hint")), "s_pos", "file")
    c = candidates(spark, d).withColumn("rank", F.row_number().over(by))
    return c.filter("rank <= 8").select("probe", "file", "s_pos", "rank")


@query(f"WITH {_HITS} SELECT probe, count(*)::BIGINT AS tried FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY file, s_pos) AS rank FROM c) WHERE rank <= 64 GROUP BY probe")
def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Places to verify per probe, at most 64 as in the exact mode."""
    by = Window.partitionBy("probe").orderBy("file", "s_pos")
    c = candidates(spark, d).withColumn("rank", F.row_number().over(by)).filter("rank <= 64")
    return c.groupBy("probe").agg(F.count("*").alias("tried"))


@query(f"WITH {_sql_runs('benchmark', 'item_id')} SELECT target, file, s, e, src FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY e - s DESC, file, s, src) AS r FROM runs) WHERE r = 1")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of every passage."""
    items = table(spark, d, "benchmark")
    found = runs(items, "item_id", table(spark, d, "documents")).withColumn("n", F.col("e") - F.col("s"))
    return matching.best(found, "target", "n", "file", "s", "src").drop("n")


@query(
    f"""WITH {_WINDOWS.replace("63, 64)", "63, 16)")},
i AS (SELECT DISTINCT d.source, w.win FROM w JOIN documents d USING (doc_id)),
b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark WHERE length(text) >= 64),
k AS (SELECT *, n // 10 AS tenth, CASE WHEN i < n // 10 THEN 0 WHEN i >= n - n // 10 THEN 2 ELSE 1 END AS z FROM b),
l AS (SELECT *, i - CASE z WHEN 0 THEN 0 WHEN 1 THEN tenth ELSE n - tenth END AS off, greatest(1, CASE z WHEN 1 THEN (n - 2 * tenth) // 10 ELSE tenth // 5 END) AS step FROM k),
s AS (SELECT * FROM l WHERE n <= 20 OR (off % step = 0 AND off // step < CASE z WHEN 1 THEN 10 ELSE 5 END)),
p AS (SELECT item_id, substr(text, q + 1, 64) AS win FROM (SELECT item_id, text, unnest(range(0, length(text) - 63)) AS q FROM s)),
h AS (SELECT DISTINCT i.source, p.item_id FROM p JOIN i USING (win)),
c AS (SELECT source, count(*) AS hits FROM h GROUP BY source),
r AS (SELECT d.source, coalesce(c.hits, 0)::BIGINT AS hits, (SELECT count(*) FROM s)::BIGINT AS samples FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN c USING (source))
SELECT source, hits, samples, round(100.0 * hits / samples, 4)::DOUBLE AS percent,
  CASE WHEN 100.0 * hits / samples >= 80 THEN 'likely' WHEN 100.0 * hits / samples >= 40 THEN 'possible' ELSE 'unlikely' END AS label,
  row_number() OVER (ORDER BY hits DESC, source)::INT AS rank FROM r"""
)
def probe_rank(spark: SparkSession, d: str) -> DataFrame:
    """Sources ranked by the share of sampled passages that they hold a window of; any shared run of matching.RUN characters has one."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").filter(F.length("text") >= matching.WINDOW).withColumn("all", F.lit(0))
    sample = matching.stratified(items, "all", ["item_id"]).select("item_id", "text")
    probes = matching.windows(sample, "item_id", 1).select("item_id", "hash")
    index = matching.windows(docs, "doc_id", matching.WINNOW).join(probes.select("hash").distinct(), "hash", "left_semi")
    index = index.join(docs.select("doc_id", "source"), "doc_id").select("source", "hash").distinct()
    hits = probes.join(index, "hash").select("source", "item_id").distinct().groupBy("source").agg(F.count("*").alias("hits"))
    n = sample.agg(F.count("*").alias("samples"))
    r = docs.select("source").distinct().join(hits, "source", "left").crossJoin(F.broadcast(n))  # one row
    hits, share = F.coalesce("hits", F.lit(0)).cast("long"), 100.0 * F.coalesce("hits", F.lit(0)) / F.col("samples")
    label = F.when(share >= 80, "likely").when(share >= 40, "possible").otherwise("unlikely")
    rank = F.row_number().over(Window.orderBy(F.desc("hits"), "source"))  # a row a source
    return r.select("source", hits.alias("hits"), "samples", F.round(share, 4).alias("percent"), label.alias("label")).withColumn("rank", rank)


@query(
    """WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
z AS (SELECT *, n // 10 AS tenth, CASE WHEN i < n // 10 THEN 0 WHEN i >= n - n // 10 THEN 2 ELSE 1 END AS stratum FROM k),
l AS (SELECT *, i - CASE stratum WHEN 0 THEN 0 WHEN 1 THEN tenth ELSE n - tenth END AS off, greatest(1, CASE stratum WHEN 1 THEN (n - 2 * tenth) // 10 ELSE tenth // 5 END) AS step FROM z)
SELECT user_id, event_id, stratum FROM l WHERE n <= 20 OR (off % step = 0 AND off // step < CASE stratum WHEN 1 THEN 10 ELSE 5 END)"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty events of every user: five early, ten from the middle, five late."""
    return matching.stratified(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "stratum")
