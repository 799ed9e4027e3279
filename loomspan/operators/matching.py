"""Content matching: an index of source windows, target windows that meet it, maximal extension.

Both sides choose their windows by content: of every WINNOW windows one after another, the
one with the least hash.  A run of RUN characters that two texts share has such windows whole,
so both choose the same of them, and no such run is missed, though either side sends about
an eighth of its windows only.  Windows travel as 64-bit rolling hashes made in Arrow
batches; texts travel only for the diagonals that are hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare

WINDOW, WINNOW = 64, 16
#: Shared runs of so many characters are surely found; shorter ones are no result.
RUN = WINDOW + WINNOW - 1
_FACTOR = 0x9E3779B97F4A7C15 | 1


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling_hashes(points: np.ndarray, window: int) -> np.ndarray:
    """A hash of every window of code points: sum of c[i + j] * f**j modulo 2**64, by doubling."""
    n = len(points) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums, width, factor = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, np.uint64(_FACTOR)
        out, done, shift = np.zeros(n, np.uint64), 0, np.uint64(1)
        left = window
        while left:
            if left & 1:
                out += shift * sums[done : done + n]
                done += width
                shift = shift * factor
            left >>= 1
            if left:
                sums = sums[: len(sums) - width] + factor * sums[width:]
                factor, width = factor * factor, width * 2
    return out


def chosen(hashes: np.ndarray, winnow: int) -> np.ndarray:
    """Places of the least of every `winnow` hashes one after another, the first of equals."""
    if len(hashes) < winnow:
        return np.empty(0, np.int64)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(mixed, winnow).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def windows(texts: DataFrame, key: str, stride: int = 1, window: int = WINDOW, winnow: int | None = None) -> DataFrame:
    """texts (key, text) -> key, pos (from 0), hash of every stride-th window that fits, or of those chosen by content."""

    def each(batches):
        for batch in batches:
            ids, counts, pos, hashes = batch[key], [], [], []
            for t in batch["text"].to_pylist():
                h = rolling_hashes(_code_points(t or ""), window)
                at = chosen(h, winnow) if winnow else np.arange(0, len(h), stride)
                counts.append(len(at))
                pos.append(at)
                hashes.append(h[at])
            if not counts:
                continue
            own = pa.array(np.repeat(np.arange(len(counts)), counts))
            out = [ids.take(own), pa.array(np.concatenate(pos).astype(np.int64)), pa.array(np.concatenate(hashes).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=[key, "pos", "hash"])

    prepare(texts.sparkSession)
    return texts.select(key, "text").mapInArrow(each, f"{key} long, pos long, hash long")


def postings(texts: DataFrame, key: str, stride: int = WINDOW, window: int = WINDOW) -> DataFrame:
    """The index as hash -> how many places, and the first of them."""
    w = windows(texts, key, stride, window)
    return w.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(F.col(key).alias("file"), F.col("pos").alias("pos"))).alias("first"))


def seeds(targets: DataFrame, target: str, sources: DataFrame, source: str, window: int = WINDOW, winnow: int = WINNOW, earlier: bool = False, most: int | None = None) -> DataFrame:
    """Pairs of target and source places with equal window hashes: target, source, diagonals (source - target) with their places.

    `earlier`: only sources of a smaller id.  A window that all sources share pairs each target
    with each of them; `most` keeps its first places only, as the exact mode's cap of 64 does.
    Without it, every place counts.
    """
    t = windows(targets, target, window=window, winnow=winnow).select(F.col(target).alias("target"), F.col("pos").alias("t_pos"), F.col("hash").alias("t_hash"))
    index = windows(sources, source, window=window, winnow=winnow).select(F.col(source).alias("source"), F.col("pos").alias("s_pos"), "hash")
    if most:
        rank = F.row_number().over(Window.partitionBy("hash").orderBy("source", "s_pos"))
        index = index.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    met = F.col("t_hash") == F.col("hash")
    both = t.join(index, met & (F.col("source") < F.col("target")) if earlier else met)
    return both.withColumn("diagonal", F.col("s_pos") - F.col("t_pos")).groupBy("target", "source", "diagonal").agg(F.array_sort(F.collect_set("t_pos")).alias("places"))


def extend(hits: DataFrame, targets: DataFrame, target: str, sources: DataFrame, source: str, window: int = WINDOW, least: int = RUN) -> DataFrame:
    """Diagonals with places -> maximal equal runs of `least` characters or more that hold a place: target, source, s, e, src.

    Runs are found in the aligned texts at once; windows whose hashes met by chance give none.
    """
    h = hits.join(targets.select(F.col(target).alias("target"), F.col("text").alias("t_text")), "target")
    h = h.join(sources.select(F.col(source).alias("source"), F.col("text").alias("s_text")), "source")

    def each(batches):
        for batch in batches:
            rows, known = [], {}
            points = lambda t: known[t] if t in known else known.setdefault(t, _code_points(t))  # noqa: B023, E731
            for t_id, s_id, diagonal, places, a, b in zip(*[batch[c].to_pylist() for c in ("target", "source", "diagonal", "places", "t_text", "s_text")], strict=True):
                a, b = points(a), points(b)
                low, high = max(0, -diagonal), min(len(a), len(b) - diagonal)
                differs = np.flatnonzero(a[low:high] != b[low + diagonal : high + diagonal]) + low
                edges = np.concatenate([[low - 1], differs, [high]])
                at = np.searchsorted(edges, places)  # the first difference at or after each place
                for k in np.unique(at):
                    s, e = int(edges[k - 1]) + 1, int(edges[k])
                    if e - s >= least and any(s <= p and p + window <= e for p, q in zip(places, at, strict=True) if q == k):
                        rows.append((t_id, s_id, s, e, s + diagonal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["target", "source", "s", "e", "src"])

    prepare(h.sparkSession)
    return h.select("target", "source", "diagonal", "places", "t_text", "s_text").mapInArrow(each, "target long, source long, s long, e long, src long")


def nearest(candidates: DataFrame, probe: str, hint: str, offset: str, k: int) -> DataFrame:
    """The k candidates of each probe nearest to its hint, the smaller offset of equals first."""
    by = Window.partitionBy(probe).orderBy(F.abs(F.col(offset) - F.col(hint)), offset)
    return candidates.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def best(candidates: DataFrame, probe: str, length: str, *ties: str) -> DataFrame:
    """The longest candidate of each probe, ties by the columns named."""
    by = Window.partitionBy(probe).orderBy(F.desc(length), *ties)
    return candidates.withColumn("rank", F.row_number().over(by)).filter("rank = 1").drop("rank")


def batches(packets: DataFrame, track: list[str], order: list[str], size: int = 64) -> DataFrame:
    """batch: packets of one track in runs of `size`, in order."""
    by = Window.partitionBy(*track).orderBy(*order)
    return packets.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("long"))


def stratified(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """20 rows of a key: 5 of its first tenth, 10 of the middle, 5 of the last tenth, at even steps; all of 20 or fewer."""
    by = Window.partitionBy(key)
    r = rows.withColumn("i", F.row_number().over(by.orderBy(*order)).cast("long") - 1).withColumn("n", F.count("*").over(by))
    tenth = F.floor(F.col("n") / 10)
    stratum = F.when(F.col("i") < tenth, 0).when(F.col("i") >= F.col("n") - tenth, 2).otherwise(1)
    start = F.when(stratum == 0, F.lit(0)).when(stratum == 1, tenth).otherwise(F.col("n") - tenth)
    wide = F.when(stratum == 1, F.col("n") - 2 * tenth).otherwise(tenth)
    want = F.when(stratum == 1, 10).otherwise(5)
    step = F.greatest(F.lit(1), F.floor(wide / want))
    at = F.col("i") - start
    chosen = (F.col("n") <= 20) | ((at % step == 0) & (F.floor(at / step) < want))
    return r.withColumn("stratum", stratum).filter(chosen).drop("n")
