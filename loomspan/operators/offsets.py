"""Offset maps: running offsets, renumbering after a filter, and composition of maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import overlap_join


def running_offsets(rows: DataFrame, key: Sequence[str], order: Sequence[str], size: str = "size", name: str = "es_offset") -> DataFrame:
    """The sum of sizes before each row of its key."""
    past = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(past), F.lit(0)).cast("long"))


def strip_and_renumber(rows: DataFrame, keep, header, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that `keep` holds for, `header` bytes cut off their front, with new running offsets."""
    kept = rows.filter(keep).withColumn("header", header.cast("long")).filter("size > header")
    kept = kept.withColumn("file_offset", F.col("file_offset") + F.col("header")).withColumn("size", F.col("size") - F.col("header"))
    return running_offsets(kept.drop("header"), key, order)


def compose(regions: DataFrame, ranges: DataFrame, key: str, width: int = 65536) -> DataFrame:
    """Regions (key, region_id, es_s, es_e) of a stream through ranges (key, file_offset, size, es_offset).

    One row for each range that a region meets: piece (from 0), file_offset, length; complete
    tells whether the ranges cover the region.
    """
    left = regions.select(key, "region_id", F.col("es_s").alias("l_s"), F.col("es_e").alias("l_e"))
    right = ranges.select(key, "file_offset", F.col("es_offset").alias("r_s"), (F.col("es_offset") + F.col("size")).alias("r_e"))
    both = overlap_join(left, right, key, width)
    start, end = F.greatest("l_s", "r_s"), F.least("l_e", "r_e")
    out = both.select(key, "region_id", "l_s", "l_e", start.alias("es_s"), (end - start).alias("length"), (F.col("file_offset") + start - F.col("r_s")).alias("file_offset"))
    by = Window.partitionBy(key, "region_id")
    out = out.withColumn("piece", F.row_number().over(by.orderBy("es_s", "file_offset")) - 1)
    out = out.withColumn("complete", F.sum("length").over(by) == F.col("l_e") - F.col("l_s"))
    return out.select(key, "region_id", "piece", "file_offset", "length", "complete")
