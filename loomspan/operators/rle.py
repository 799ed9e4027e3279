"""Run-length form of offset maps, its indexes, and whole numbers of variable length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def uvarint_length(v: Column) -> Column:
    """Bytes that a non-negative number takes at seven bits each."""
    bits = F.length(F.bin(v.cast("long")))
    return F.ceil(bits / 7).cast("int")


def with_gaps(ranges: DataFrame, key: str) -> DataFrame:
    """gap: what lies between a range's end and the next one's start; null for the last."""
    by = Window.partitionBy(key).orderBy("file_offset")
    return ranges.withColumn("gap", F.lead("file_offset").over(by) - F.col("file_offset") - F.col("size"))


def usual_gap_and_size(ranges: DataFrame, key: str, sample: int | None = None) -> DataFrame:
    """The most frequent gap and size of a key's ranges, the smaller of equals; 0 beyond 16 bits.  sample: of its first ranges only."""
    r = with_gaps(ranges, key)
    if sample:
        by = Window.partitionBy(key).orderBy("file_offset")
        r = r.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= sample)

    def mode(c: str, name: str) -> DataFrame:
        counts = r.filter(F.col(c).isNotNull()).groupBy(key, F.col(c).alias("value")).count()
        best = counts.groupBy(key).agg(F.max_by("value", F.struct("count", (-F.col("value")).alias("low"))).alias(name))
        return best.withColumn(name, F.when(F.col(name).between(0, 65535), F.col(name)).otherwise(0).cast("long"))

    sizes = mode("size", "default_size")
    return sizes.join(mode("gap", "default_gap"), key, "left").select(key, F.coalesce("default_gap", F.lit(0).cast("long")).alias("default_gap"), "default_size")


def encode_runs(ranges: DataFrame, key: str, defaults: DataFrame) -> DataFrame:
    """Ranges -> runs: first offset, size, the gap before it, and how many usual ranges follow on.

    A range is usual if its size is the default and the gap before it is the default.
    """
    by = Window.partitionBy(key).orderBy("file_offset")
    r = ranges.join(defaults, key)
    before = F.col("file_offset") - F.lag(F.col("file_offset") + F.col("size")).over(by)
    r = r.withColumn("before", before)
    usual = F.coalesce((F.col("before") == F.col("default_gap")) & (F.col("size") == F.col("default_size")), F.lit(False))
    r = r.withColumn("breaks", (~usual).cast("int"))
    r = r.withColumn("run", F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    first = lambda c: F.min_by(c, "file_offset")
    out = r.groupBy(key, "run", "default_gap", "default_size").agg(
        F.min("file_offset").alias("file_offset"), first("size").alias("size"), first("before").alias("before"), (F.count("*") - 1).alias("follow")
    )
    return out.select(key, "run", "file_offset", "size", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "follow", "default_gap", "default_size")


def decode_runs(runs: DataFrame, key: str) -> DataFrame:
    """Runs -> ranges, by arithmetic from each run's first."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("follow"))).alias("i")
    r = runs.select("*", i)
    start = F.when(F.col("i") == 0, F.col("file_offset")).otherwise(
        F.col("file_offset") + F.col("size") + F.col("default_gap") + (F.col("i") - 1) * (F.col("default_size") + F.col("default_gap"))
    )
    return r.select(key, start.alias("file_offset"), F.when(F.col("i") == 0, F.col("size")).otherwise(F.col("default_size")).alias("size"))


def every_nth(ranges: DataFrame, key: str, n: int) -> DataFrame:
    """The coarse index: each n-th range of a key, from the first."""
    by = Window.partitionBy(key).orderBy("file_offset", "es_offset")
    return ranges.withColumn("ordinal", F.row_number().over(by).cast("long") - 1).filter(F.col("ordinal") % n == 0).select(key, "ordinal", "file_offset", "es_offset")
