"""The change-event operators on streams: the same results as their batch forms, continuously."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Debounced batches of a key; a batch is sent once the watermark is past its end."""
    w = F.session_window(at, gap).alias("w")
    out = events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return out.select(key, "first", "last", "n")


def first_pending(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """One event of a key while it is pending: later ones within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fence(events: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """A stream against the static table of current generations."""
    return events.join(current, [key, generation], "left_semi")


def changes(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Events whose value differs from the key's last one, which is kept as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t")
        last = state.get[0] if state.exists else None
        before = [last, *rows["v"].tolist()[:-1]]
        state.update((int(rows["v"].iloc[-1]),))
        yield rows[[b is None or b != v for b, v in zip(before, rows["v"], strict=True)]][["k", "v", "t"]]

    e = events.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("v"), F.col(at).cast("double").alias("t"))
    return e.groupBy("k").applyInPandasWithState(step, "k long, v long, t double", "v long", "append", GroupStateTimeout.NoTimeout)


def bounded_batches(events: DataFrame, key: str, at: str, idle: float, most: float, late: str = "0 seconds") -> DataFrame:
    """Batches that end `idle` seconds after their last event or `most` after their first, by event time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0.0, 0.0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], first, min(last + idle, first + most), n))
            state.remove()
        else:
            for t in pd.concat(list(batches))["t"].sort_values():
                if n and t > min(last + idle, first + most):
                    out.append((k[0], first, min(last + idle, first + most), n))
                    n = 0
                first, last, n = (t if n == 0 else first), t, n + 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(int(1000 * min(last + idle, first + most)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "first", "flush", "n"])

    e = events.withWatermark(at, late).select(F.col(key).cast("long").alias("k"), F.col(at).cast("double").alias("t"), at)
    return e.groupBy("k").applyInPandasWithState(step, "k long, first double, flush double, n long", "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def last_writer_sink(path: str, key: str, order: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch's last writers into the table at `path`, versions side by side.

    A version is written whole before it is named current, so a batch that fails half-way and
    comes again leaves the same table; the version of an epoch before the last is removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key, *order, *values)
        if epoch:
            new = spark.read.parquet(f"{path}/v{epoch - 1}").select(key, *order, *values).unionByName(new)
        out = new.groupBy(key).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("v")).select(key, "v.*")
        out.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return merge


def notify_sink(send: Callable[[str], None], source: str, event: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one message for a batch, its different sources and events in order."""

    def one(batch: DataFrame, epoch: int) -> None:
        line = F.concat_ws(": ", source, event)
        found = batch.agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text")).first()
        if found and found["text"]:
            send(found["text"])

    return one
