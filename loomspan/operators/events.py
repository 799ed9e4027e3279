"""Change events in batch form: policies, debouncing, fencing, merging of states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outcome(policy: Column, exists: Column, size: Column, expected: Column, queued: Column, queue: int = 256) -> Column:
    """What a change of a source leads to: warn, disable or verify."""
    checked = F.when(~exists, "disable").when(size != expected, "disable").when(queued >= queue, "disable").otherwise("verify")
    return F.when(policy == "warn", "warn").when(policy == "disable", "disable").otherwise(checked)


def sessions(events: DataFrame, key: str | None, at: str, gap: str) -> DataFrame:
    """Debounced batches: events no more than `gap` apart, per key or over all."""
    by = [F.session_window(at, gap).alias("w"), *([key] if key else [])]
    out = events.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return out.select(*([key] if key else []), "first", "last", "n")


def bounded_batches(events: DataFrame, key: str, at: str, idle: float, most: float) -> DataFrame:
    """Batches that end after `idle` seconds without an event, or `most` seconds after their first.

    A fold over a key's events in order, which windows can't say: where a batch ends decides
    where the next begins.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows, first, last, n = [], None, None, 0
        for t in group["t"].sort_values():
            if n and t > min(last + idle, first + most):
                rows.append((first, min(last + idle, first + most), n))
                n = 0
            first, last, n = (t if n == 0 else first), t, n + 1
        if n:
            rows.append((first, min(last + idle, first + most), n))
        return pd.DataFrame([(group["k"].iloc[0], *r) for r in rows], columns=["k", "first", "flush", "n"])

    e = events.select(F.col(key).cast("long").alias("k"), F.col(at).cast("timestamp").cast("double").alias("t"))
    out = e.groupBy("k").applyInPandas(fold, "k long, first double, flush double, n long")
    return out.withColumnRenamed("k", key)


def first_pending(events: DataFrame, key: str, at: Column, *order: str) -> DataFrame:
    """The first event of each key and span of time: later ones are pending already."""
    by = Window.partitionBy(key, "span").orderBy(*order)
    return events.withColumn("span", at).withColumn("rank", F.row_number().over(by)).filter("rank = 1").drop("rank")


def fence(events: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """Events of their key's current generation; those of older ones are dropped."""
    return events.join(current, [key, generation], "left_semi")


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last writer's values of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")


def enabled(latest_by_source: DataFrame, file: str, ok: Column) -> DataFrame:
    """A file is enabled if the last check of every source of it passed."""
    return latest_by_source.groupBy(file).agg(F.bool_and(ok).alias("enabled"), F.count("*").alias("sources"))


def changes(states: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """States that differ from the one before; the first counts."""
    by = Window.partitionBy(key).orderBy(*order)
    return states.withColumn("before", F.lag(value).over(by)).filter(~F.col(value).eqNullSafe(F.col("before")) | F.col("before").isNull())


def edge_retry(batches: DataFrame, track: str) -> DataFrame:
    """Batches with a miss at their head get the tail of the last batch that has one, in order."""
    by = Window.partitionBy(track).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.last(F.when(F.col("tail").isNotNull(), F.struct("batch", "tail")), ignorenulls=True).over(by)
    return batches.withColumn("from_batch", tail["batch"]).withColumn("hint", tail["tail"]).filter("head_missed AND hint IS NOT NULL")


def locality(probes: DataFrame, matches: DataFrame, track: str, at: str) -> DataFrame:
    """Where the last match before a probe says that its source is: src_end plus what lies between, and three around it.

    Only within twice the size of the probe, from a size of 64.
    """
    from .intervals import as_of

    hinted = as_of(probes, matches, track, at, ["src_end", "t_end"])
    lies = F.col(at) - F.col("t_end")
    hinted = hinted.filter((F.col("size") >= 64) & (lies >= 0) & (lies <= 2 * F.col("size")))
    return hinted.select(track, at, "size", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("shift"), "src_end", lies.alias("lies")).select(track, at, (F.col("src_end") + F.col("lies") + F.col("shift")).alias("src"))


