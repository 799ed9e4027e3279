"""Interval maps: merging with priority, complement, range joins, coverage.

Intervals are half-open and belong to a key (a target); every window is partitioned by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_regions(regions: DataFrame, key: str, identity: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Regions (key, s, e, src, identity) that overlap become disjoint; earlier ones win.

    A region that starts within what is covered loses that part; one that then continues the
    last region on its diagonal (src - s) and identity is joined to it.  Touching regions stay
    apart.  Two windows and one aggregation over the same partitioning.
    """
    by = Window.partitionBy(key).orderBy("s", *order)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    r = regions.withColumn("covered", F.max("e").over(past)).filter("covered IS NULL OR e > covered")
    r = r.withColumn("diagonal", F.col("src") - F.col("s"))
    same = F.lit(True)
    for c in (*identity, "diagonal"):
        same &= F.col(c).eqNullSafe(F.lag(c).over(by))
    goes_on = F.coalesce(F.col("s") < F.col("covered"), F.lit(False)) & same
    r = r.withColumn("fresh", (~goes_on).cast("int"))
    r = r.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("s", F.greatest("s", F.coalesce("covered", "s")))
    out = r.groupBy(key, "island", *identity, "diagonal").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return out.select(key, "s", "e", *identity, (F.col("s") + F.col("diagonal")).alias("src"))


def complement(regions: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Disjoint regions (key, s, e, file, src) and sizes (key, size) -> entries that tile [0, size).

    source is 0 for what no region covers, file + 1 else; the source_offset of uncovered
    stretches runs over their lengths, in order.
    """
    ends = sizes.select(key, F.col("size").alias("s"), F.col("size").alias("e"), F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("src"), F.lit(True).alias("tail"))
    rows = regions.select(key, "s", "e", F.col("file").cast("long").alias("file"), "src", F.lit(False).alias("tail")).unionByName(ends)
    by = Window.partitionBy(key).orderBy("s", "tail")
    rows = rows.withColumn("from", F.coalesce(F.lag("e").over(by), F.lit(0).cast("long")))
    gap = F.struct(F.col("from").alias("mkv_offset"), (F.col("s") - F.col("from")).alias("length"), F.lit(0).cast("long").alias("source"), F.lit(None).cast("long").alias("source_offset"))
    own = F.struct(F.col("s").alias("mkv_offset"), (F.col("e") - F.col("s")).alias("length"), (F.col("file") + 1).alias("source"), F.col("src").alias("source_offset"))
    out = rows.select(key, F.explode(F.array(gap, own)).alias("x")).select(key, "x.*").filter("length > 0")
    spooled = Window.partitionBy(key).orderBy("mkv_offset").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.coalesce(F.sum(F.when(F.col("source") == 0, F.col("length"))).over(spooled), F.lit(0)).cast("long")
    return out.withColumn("source_offset", F.when(F.col("source") == 0, missing).otherwise(F.col("source_offset")))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """left (key, l_s, l_e, ...) and right (key, r_s, r_e, ...) where they overlap.

    Both sides go to the bins of `width` that they touch and meet by equality; a pair counts in
    the first bin that both touch, so none comes twice.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.filter("l_e > l_s").withColumn("bin", bins("l_s", "l_e"))
    b = right.filter("r_e > r_s").withColumn("bin", bins("r_s", "r_e"))
    both = a.join(b, [key, "bin"])
    return both.filter("l_s < r_e AND r_s < l_e").filter(F.col("bin") == F.floor(F.greatest("l_s", "r_s") / width)).drop("bin")


def as_of(points: DataFrame, rows: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """points (key, at, ...) with the values of the last of rows (key, at, values) at or before each."""
    extra = [c for c in points.columns if c not in (key, at)]
    p = points.select(key, at, F.lit(1).alias("is_point"), *extra, F.lit(None).cast(rows.select(F.struct(*values)).schema[0].dataType).alias("held"))
    r = rows.select(key, at, F.lit(0).alias("is_point"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], F.struct(*values).alias("held"))
    by = Window.partitionBy(key).orderBy(at, "is_point").rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(r).withColumn("held", F.last("held", ignorenulls=True).over(by)).filter("is_point = 1")
    return out.select(key, at, *extra, *[F.col(f"held.{v}").alias(v) for v in values])


def coalesce_adjacent(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (key, file_offset, size, es_offset) that continue each other in both offsets become one."""
    by = Window.partitionBy(key).orderBy("file_offset", "es_offset")
    after = lambda c: F.lag(F.col(c) + F.col("size")).over(by)
    breaks = ~F.coalesce((after("file_offset") == F.col("file_offset")) & (after("es_offset") == F.col("es_offset")), F.lit(False))
    r = ranges.withColumn("breaks", breaks.cast("int"))
    r = r.withColumn("island", F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = r.groupBy(key, "island").agg(F.min("file_offset").alias("file_offset"), F.sum("size").alias("size"), F.min("es_offset").alias("es_offset"))
    return out.select(key, "file_offset", "size", "es_offset")


def covered_chunks(marks: DataFrame, key: str, chunk: int = 4096) -> DataFrame:
    """Chunks that one of marks (key, s, e) covers fully."""
    first, last = F.ceil(F.col("s") / chunk), F.floor(F.col("e") / chunk) - 1
    m = marks.withColumn("first", first).withColumn("last", last).filter("first <= last")
    return m.select(key, F.explode(F.sequence("first", "last")).alias("chunk")).distinct()


def blocks_of(entries: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """For each block of a target, its last entry at or before the block's start."""
    starts = sizes.filter("size > 0").select(key, F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block))).alias("block"))
    starts = starts.withColumn("at", F.col("block") * block)
    rows = entries.select(key, F.col("mkv_offset").alias("at"), F.col("ordinal"))
    return as_of(starts, rows, key, "at", ["ordinal"]).select(key, "block", "ordinal")


def clip(s: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(s, low), high)
