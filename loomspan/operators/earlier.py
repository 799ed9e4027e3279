"""Runs that texts share with earlier ones, without pairing each text with every other that holds a window.

A map of a text needs few of its runs: merge_regions() takes them by start, source and place
there, and drops one that ends no later than those before it.  So a run of [s, e) matters only
if no earlier text has [s - 1, e), and no source before its own has [s, e).  earlier_runs()
gives all of these, though not all others.

Buckets.  Both sides choose windows of WINDOW characters by content, of REACH one after
another those with the least hash; a run of RUN characters or more has one that begins less
than REACH after it.  A bucket is a window's places.  Where all of them have the same REACH
characters before the window, every run holds an earlier chosen window, and the bucket has
nothing to give; nor has one of a single text.

Search.  The places of a bucket are split by the characters before the window, one at a time;
where they differ, some run may begin.  There, all are compared with the first place (by
text and place): that is the first source of each, up to where it differs.  Those that
differ at the same character in the same way go on among themselves with the first of them,
which is the next source with a longer run.  So a place is compared once for each source that
it may need, however many have the window, and not with each other place.

Copies.  A text that is there already under a smaller id is no source, and only its begin is a
target.  Places of a bucket with the same characters around them are searched as one.

Long runs.  Texts travel in pieces: OWN characters from the window on, then FOLD times as far
for places that still agree with those of another text, until none does.  Every comparison is
one of characters; hashes only bring places together.

A place is one row with 144 characters in a bucket, and a bucket is searched in one task.
Null text is an empty text, texts without an id are none, and an id is that of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare, save
from .matching import RUN, _code_points, rolling_hashes

WINDOW = REACH = 40
OWN, FOLD = 104, 4
#: Places that are sent to every task at most, in place of shuffling the texts.
SENT = 500_000
_PLACES = "doc long, pos long, k1 long, k2 long"
_FOUND = "target long, source long, s long, e long, src long"


def _sliding(x: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """least of every n numbers one after another, by doubling."""
    width = 1
    while 2 * width <= n:
        x, width = least(x[:-width], x[width:]), 2 * width
    return least(x[: len(x) - n + width], x[n - width :]) if width < n else x


def dense(hashes: np.ndarray, winnow: int = REACH) -> np.ndarray:
    """Places whose hash is the least of some `winnow` one after another, all of equals."""
    if len(hashes) < winnow:
        return np.empty(0, np.int64)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    least = np.pad(_sliding(mixed, winnow, np.minimum), winnow - 1)
    return np.flatnonzero(_sliding(least, winnow, np.maximum) == mixed)


def _windows(docs: DataFrame) -> DataFrame:
    """docs (doc, text, copy) -> doc, pos, hash of the chosen windows, and of the REACH characters before them (0 where there are fewer).

    Of a copy, only windows that a run from its begin has: that with the first such text ends last, and has all others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for t, copy in zip(batch["text"].to_pylist(), batch["copy"].to_pylist(), strict=True):
                h = rolling_hashes(_code_points(t[: 3 * REACH] if copy else t), WINDOW)
                at = dense(h)
                at = at[at < REACH] if copy else at
                counts.append(len(at))
                out.append((at, h[at], np.where(at >= REACH, h[np.maximum(at - REACH, 0)], 0).astype(np.uint64)))
            if sum(counts):
                pos, own, before = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                doc = batch["doc"].take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(pos), pa.array(own), pa.array(before)], names=["doc", "pos", "hash", "before"])

    return docs.mapInArrow(each, "doc long, pos long, hash long, before long")


def _contexts(docs: DataFrame, places: DataFrame, start: int, size: int, few: bool) -> DataFrame:
    """Each place with the characters before its window, `size` characters from `start` after its begin, and whether more follow."""
    lists = places.groupBy("doc").agg(F.collect_list(F.struct("pos", "k1", "k2")).alias("places"))
    both = docs.join(F.broadcast(lists) if few else lists, "doc").select("doc", "text", "places")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (doc, t) in enumerate(zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                held = batch["places"].slice(k, 1).flatten()
                pos, k1, k2 = (held.field(c) for c in ("pos", "k1", "k2"))
                at = pos.to_pylist()
                before = pa.array([t[max(0, p - REACH) : p] for p in at], pa.string())
                own = pa.array([t[p + start : p + start + size] for p in at], pa.string())
                more = pa.array([len(t) > p + start + size for p in at])
                yield pa.RecordBatch.from_arrays([k1, k2, pa.array([doc] * len(at), pa.int64()), pos, before, own, more], names=["k1", "k2", "doc", "pos", "before", "own", "more"])

    return both.mapInArrow(each, "k1 long, k2 long, doc long, pos long, before string, own string, more boolean")


def _points(texts: list[str]) -> np.ndarray:
    """A row of code points a text, all of one size, in bytes where they fit."""
    whole = "".join(texts)
    try:
        raw = np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    return raw.reshape(len(texts), -1)


def search(doc: np.ndarray, pos: np.ndarray, kind: np.ndarray, kinds: list[tuple[str, str, bool]], start: int, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A bucket's places in order -> its runs that end within a piece (target, source, s, e, src), and classes of places that agree beyond.

    kind: of each place, numbered as they come; kinds: characters before the window, its piece, whether more follow.  The
    first place of a kind is the source of all that may take one of them.  What it takes is of no use to places of
    later texts: those share more with the first itself, from further before, unless the text begins there.
    """
    before, own, more = [k[0] for k in kinds], [k[1] for k in kinds], np.array([k[2] for k in kinds])
    right, left = _points([t.ljust(size, "\0") for t in own]), _points([t.rjust(REACH, "\0") for t in before])[:, ::-1]
    ends, edges = np.array([len(t) for t in own]), np.array([len(t) for t in before])
    members = np.argsort(kind, kind="stable")
    counts = np.bincount(kind)
    starts = np.cumsum(counts) - counts
    first, last = doc[members[starts]], doc[members[starts + counts - 1]]
    place = pos[members[starts]]
    most = np.where(edges < REACH, last, first)  # the last text that takes sources of other kinds
    found: list[tuple[np.ndarray, ...]] = []

    def taken(x: np.ndarray, y: int, back: int, agree: np.ndarray) -> None:
        """Runs of kinds x with the first place of kind y."""
        n = counts[x]
        at = members[np.repeat(starts[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        x, agree = np.repeat(x, n), np.repeat(agree, n)
        fit = (doc[at] > first[y]) & (doc[at] <= most[x])
        at, agree = at[fit], agree[fit]
        found.append((at, pos[at] - back, np.full(len(at), first[y]), np.full(len(at), place[y] - back), pos[at] + start + agree))

    def sources(idx: np.ndarray, back: int, symbol: np.ndarray) -> None:
        """Runs that begin `back` characters before the windows; symbol: what is before that."""
        todo = [(idx, 0)]
        while todo:
            idx, depth = todo.pop()
            y, rest = idx[0], idx[1:]
            if most[rest].max() <= first[y]:
                continue
            differs = right[rest, depth:] != right[y, depth:]
            at = differs.argmax(axis=1)
            agree = np.where(differs[np.arange(len(rest)), at], depth + at, size)
            agree = np.minimum(agree, np.minimum(ends[rest], ends[y]))
            ended = (agree < size) | ~more[rest] | ~more[y]
            hit = ended & (most[rest] > first[y]) & (symbol[rest] != symbol[y]) & (back + start + agree >= RUN)
            if hit.any():
                taken(rest[hit], y, back, agree[hit])
            on = agree < ends[rest]
            rest, agree = rest[on], agree[on]
            if len(rest) > 1:
                key = agree.astype(np.int64) << 21 | right[rest, agree]
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                todo += [(rest[g], int(agree[g[0]])) for g in np.split(order, cuts) if len(g) > 1]

    todo = [(np.arange(len(kinds)), 0)] if len(kinds) > 1 else []
    while todo:
        idx, back = todo.pop()
        if most[idx].max() <= first[idx[0]]:
            continue
        varies = (left[idx, back:] != left[idx[0], back:]).any(axis=0)
        back = min(back + int(varies.argmax()) if varies.any() else REACH, int(edges[idx].min()))
        if back >= REACH:
            continue
        symbol = left[:, back].astype(np.int64)
        edge = np.flatnonzero(edges == back)
        symbol[edge] = -1 - edge  # a text's begin is like no character and no other begin
        sources(idx, back, symbol)
        order = np.argsort(symbol[idx], kind="stable")
        cuts = np.flatnonzero(np.diff(symbol[idx][order])) + 1
        todo += [(idx[g], back + 1) for g in np.split(order, cuts) if len(g) > 1]
    for x in np.flatnonzero((edges < REACH) & ~more & (last > first) & (edges + start + ends >= RUN)):
        taken(np.array([x]), x, int(edges[x]), ends[x : x + 1])

    runs = [np.empty(0, np.int64)] * 5
    if found:
        x, s, f, src, e = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((src, f, s, x))
        x, s, f, src, e = (c[order] for c in (x, s, f, src, e))
        if len(x):
            high = np.maximum.accumulate(e + x * (int(e.max()) + 1))  # of a place, by its order
            keep = np.concatenate([[True], (x[1:] != x[:-1]) | (high[1:] > high[:-1])])
            runs = [doc[x][keep], f[keep], s[keep], e[keep], src[keep]]
    classes: dict[str, list[int]] = {}
    for k in np.flatnonzero(more):
        classes.setdefault(own[k], []).append(int(k))
    beyond = []
    for of in classes.values():
        if (len(of) > 1 or edges[of[0]] < REACH) and last[of].max() > first[of[0]]:
            beyond.append(np.sort(np.concatenate([members[starts[k] : starts[k] + counts[k]] for k in of])))
    return runs, beyond


def _searched(contexts: DataFrame, start: int, size: int) -> DataFrame:
    """Runs, and places that go on: those have no source, their place in s, and their class in e and src."""
    rows = contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc", "pos")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        held: list[tuple[np.ndarray, ...]] = []
        kinds: dict[tuple[str, str, bool], int] = {}

        def close() -> None:
            doc, pos, kind = (np.concatenate(c) for c in zip(*held, strict=True))
            runs, beyond = search(doc, pos, kind, list(kinds), start, size)
            none = np.zeros(len(runs[0]), bool)
            out.append([*runs, none])
            for g in beyond:
                first = np.full(len(g), g[0])
                out.append([doc[g], np.zeros(len(g), np.int64), pos[g], doc[first], pos[first], ~np.zeros(len(g), bool)])

        def written() -> Iterator[pa.RecordBatch]:
            target, source, s, e, src, none = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            if len(target):
                yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(source, mask=none), pa.array(s), pa.array(e), pa.array(src)], names=["target", "source", "s", "e", "src"])

        key = None
        for batch in batches:
            k1, k2, doc, pos = (batch[c].to_numpy() for c in ("k1", "k2", "doc", "pos"))
            said = list(zip(*[batch[c].to_pylist() for c in ("before", "own", "more")], strict=True))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(k1)], strict=True):
                if (k1[a], k2[a]) != key:
                    if held:
                        close()
                    held, kinds, key = [], {}, (k1[a], k2[a])
                held.append((doc[a:b].copy(), pos[a:b].copy(), np.array([kinds.setdefault(x, len(kinds)) for x in said[a:b]])))
            if len(out) > 200:
                yield from written()
        if held:
            close()
        if out:
            yield from written()

    return rows.mapInArrow(each, _FOUND)


def earlier_runs(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """docs (key, text) -> runs (target, source, s, e, src) with texts of smaller keys, all that merge_regions() keeps among them."""
    prepare(spark)
    docs = docs.select(F.col(key).alias("doc"), "text").filter("doc IS NOT NULL AND text IS NOT NULL")
    same = docs.select("doc", F.sha2("text", 256).alias("digest")).withColumn("least", F.min("doc").over(Window.partitionBy("digest")))
    copies = save(spark, same.filter("doc <> least").select("doc", F.lit(True).alias("copy")), "earlier-copies")
    marked = docs.join(F.broadcast(copies) if copies.count() <= SENT else copies, "doc", "left").select("doc", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    # A begin of a text is like no other.
    before = F.when(F.col("pos") < REACH, F.xxhash64("doc", "pos")).otherwise(F.col("before"))
    rows, by = _windows(marked).withColumn("before", before), Window.partitionBy("hash")
    for c in ("before", "doc"):
        rows = rows.withColumn(f"{c}_0", F.min(c).over(by)).withColumn(f"{c}_1", F.max(c).over(by))
    rows = rows.filter("before_0 <> before_1 AND doc_0 <> doc_1")
    places = save(spark, rows.select("doc", "pos", F.col("hash").alias("k1"), F.lit(0).cast("long").alias("k2")), "earlier-places")
    found, start, size = spark.createDataFrame([], _FOUND), 0, OWN
    while n := places.count():
        out = save(spark, _searched(_contexts(docs, places, start, size, n <= SENT), start, size), "earlier-runs")
        found = found.unionByName(out.filter("source IS NOT NULL"))
        places = out.filter("source IS NULL").select(F.col("target").alias("doc"), F.col("s").alias("pos"), F.col("e").alias("k1"), F.col("src").alias("k2"))
        start, size = start + size, (FOLD - 1) * (start + size)
    return found
