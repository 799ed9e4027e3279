"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations only.

Sizes are words.  Every source gets a target of words by its weight, capped at `cap` times
what it has; the excess goes to the others by weight until none is above its cap.  Complete
epochs of a source come first; of what is left, documents are taken in the order of
-ln(u) / quality, u a hash of doc_id, until the budget is reached.  The document at the edge
is taken if half of it lies within the budget, so a source misses its target by half a
document at most.

No window runs over the documents of a source: they are counted in buckets of the key, the
bucket in which the budget ends is found from the counts, by spans of buckets first, and only
that bucket is sorted.
The result is one row of cut-offs a source; documents are then decided one by one.

Nulls and ties: a null source is a source of its own, after all others; null text has size
0; documents of a source with equal id and size (repeated rows) are taken or left together.
An empty table gives no rows, a text of any length a size.  Sources have one row each in the tables kept aside; their
join is Spark's own choice by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

#: Documents that a bucket of the key holds, about, if all were of one source and of the lowest quality.
BUCKET_ROWS = 1024
#: The lowest quality.
LEAST = 0.25
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 where words have 3 to 10 characters on average, else 0.25."""
    mean = (F.coalesce(F.length(text), F.lit(0)) + 1).cast("double") / F.greatest(size, F.lit(1)).cast("double") - 1
    return F.when((mean >= 3) & (mean <= 10), F.lit(1.0)).otherwise(F.lit(LEAST))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of the id's MD5."""
    n = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10)
    return (n.cast("double") + 0.5) / F.lit(float(2**48))


def with_key(docs: DataFrame) -> DataFrame:
    """docs with size and key.  The smaller the key, the sooner a document is taken."""
    docs = docs.withColumn("size", words(F.col("text")))
    return docs.withColumn("key", -F.log(uniform(F.col("doc_id"))) / quality(F.col("text"), F.col("size")))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    One row a source; the windows over all of them hold no documents.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(kinds, (F.row_number().over(order) - 1) % n + 1))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size").cast("double"))
    # Filling to a level: sources by most / weight; those before the level are full.
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("all_size", F.lit(float(share)) * F.sum("source_size").over(every).cast("double"))
        .withColumn("full_size", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    s = s.withColumn("level", (F.col("all_size") - F.col("full_size")) / F.col("open_weight"))
    s = s.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("most"))
    level = F.coalesce(F.min(F.when(~F.col("is_full"), F.struct(F.col("open_weight") * -1, "level"))).over(every)["level"], F.lit(0.0))
    target = F.when(F.col("is_full"), F.col("most")).otherwise(level * F.col("weight"))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def bucket_of(key: Column, buckets: Column) -> Column:
    """Rising with the key.  exp(-key) is u ** (1 / quality), so its power LEAST is even for the
    lowest quality, and no bucket holds more than 1 / LEAST of its share of any other."""
    return F.least(F.floor((1 - F.exp(-key * LEAST)) * buckets), buckets - 1).cast("long")


def cutoffs(
    spark: SparkSession, rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """rows (source, doc_id, size, key), cheap to read again -> one row a source: source_size,
    target, epochs and the last (key, doc_id, size) of the fractional epoch."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), F.lit(buckets)))

    src = targets(sizes, weights, share, cap)
    src = src.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    src = save(spark, src.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")

    # Where the budget ends: in which span of buckets, then in which bucket of it.  Either way a
    # source has about the square root of its buckets, so no window over one source grows large.
    span = max(1, int(buckets**0.5))
    held = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("span", F.floor(F.col("bucket") / span))
    held = save(spark, held, "mix-held")
    wide = _ends(held.groupBy("source", "span").agg(F.sum("held").alias("held")), src.select("source", F.lit(0).cast("long").alias("base"), "rest"), "span")
    within = _join(held, wide.select("source", F.col("span").alias("in_span"), "base", "rest")).filter("span = in_span")
    cut = save(spark, _ends(within.select("source", "bucket", "held"), wide.select("source", "base", "rest"), "bucket").withColumnRenamed("base", "before"), "mix-cuts")

    # Only documents of the bucket at a source's edge go on from here.
    c = cut.select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before", "rest")
    edge = rows.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    edge = edge.groupBy("source", "key", "doc_id", "size", "before", "rest").agg(F.sum("size").alias("unit"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("unit").over(run), F.lit(0)))
    edge = edge.filter(F.col("before") + F.col("unit") / 2 <= F.col("rest"))
    last = edge.groupBy("source").agg(F.max(F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "size")).alias("last"))
    out = _join(src, cut.select("source", "bucket"))
    out = _join(out, last).select("source", "source_size", "weight", "target", "epochs", "bucket", "last")
    return save(spark, out.withColumn("buckets", F.lit(buckets)), "mix-cutoffs")


def _ends(held: DataFrame, budget: DataFrame, part: str) -> DataFrame:
    """The part of each source in which its budget ends: source, part, base (words before it) and rest.

    held (source, part, held), budget (source, base, rest).
    """
    run = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = _join(held, budget).withColumn("base", F.col("base") + F.coalesce(F.sum("held").over(run), F.lit(0)))
    return held.filter((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("held"))).select("source", part, "base", "rest")


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, null being a source."""
    right = right.withColumnRenamed("source", "r_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source")


def mix(spark: SparkSession, docs: DataFrame, texts: bool = True, **how) -> DataFrame:
    """docs with size, source_size, target, copies (times that the mix takes it) and taken (words).

    Columns of docs with one of these names are replaced.  texts: whether text stays; without
    it, words are counted once, else again as the documents are read again.
    """
    own = {"size", "key", "source_size", "weight", "target", "epochs", "bucket", "last", "buckets", "copies", "taken", "r_source"}
    docs = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in own])
    keyed = with_key(docs)
    rows = save(spark, keyed.select("source", "doc_id", "size", "key") if texts else keyed.drop("text"), "mix-keys")
    cut = cutoffs(spark, rows.select("source", "doc_id", "size", "key"), **how)
    out = _join(keyed if texts else rows, cut)
    bucket = bucket_of(F.col("key"), F.col("buckets"))
    place = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "size")
    before = bucket < F.col("bucket")
    within = (bucket == F.col("bucket")) & (place <= F.col("last"))
    chosen = F.coalesce(before | within, F.lit(False)).cast("long")
    out = out.withColumn("copies", F.col("epochs") + chosen).withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("key", "weight", "epochs", "bucket", "last", "buckets")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS chars
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / CASE WHEN (chars + 1)::DOUBLE / greatest(size, 1)::DOUBLE - 1 BETWEEN 3 AND 10 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size::DOUBLE AS most
  FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS all_size,
         coalesce(sum(most) OVER b, 0.0)::DOUBLE AS full_size,
         (sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0.0) AS open_weight
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (all_size - full_size) / open_weight AS level FROM l),
g AS (SELECT *, level * weight >= most AS is_full FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most ELSE coalesce((SELECT level FROM g WHERE NOT is_full ORDER BY open_weight DESC LIMIT 1), 0.0) * weight END AS target
  FROM g),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
