r"""Near-duplicates by the Jaccard similarity of word shingles, verified exactly.

Two texts link if their sets of shingles of `width` words (as in simhash: ASCII lower case,
cut at white space; a text of fewer words is one shingle) share NEAR or more of their union.
A component has all that links reach.

Candidates.  SimHash, as in simhash over the same shingles, repeats counted: texts whose
fingerprints reach each other by links of MOST bits or fewer, which the pigeonring search
finds, meet in a bucket.  Pairs near 0.8 differ in 5 to 10 bits, so most need more.
MinHash beside it: of each of BANDS * ROWS permutations of the shingles' XXH64, a text has
the smallest; texts that agree on all ROWS of a band meet in a bucket.  A pair of similarity
s meets in none with probability (1 - s**ROWS)**BANDS: 5e-8 at 0.8, and less above.  Meeting
is no link: in a bucket every link is checked on the whole sets, in whole numbers.

Large groups.  Texts with equal sets are one class, joined to their documents at the end.  A
bucket is searched from one member to the next, each compared only with those that no
earlier one has reached, and only the links of a spanning forest leave it.  A bucket of more
than BLOCK classes is cut into blocks, and each two blocks are searched on their own.  Sets
travel only for classes that share a bucket with another, and of buckets with the same
members, as near copies share many, only to one.

Null text has no words; texts without words are one class.  A text of any length is one set.
Repeated rows are of one class.  An empty table gives no rows.  Other columns stay, whatever
their names, but for k_own, k_id and k_h.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_pass, in_arrow, portions, save
from .components import components
from .simhash import _shingles, hashes_fingerprints
from .simhash import linked as fingerprint_links

NEAR = (4, 5)  # 0.8, as a fraction
BANDS, ROWS, BLOCK = 32, 4, 2048
#: Differing bits by which fingerprints link at most.
MOST = 4
#: Hashes of eight bytes that a broadcast holds at most.
SENT = 1_000_000
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's shingles."""
    return [np.unique(np.array(_shingles(t, width), np.uint64)) for t in texts]


def set_class(own: np.ndarray) -> int:
    """A hash that names a set, signed."""
    x = xxh64_intdigest(own.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys of buckets, signed; no set may be empty."""
    h = np.concatenate(sets)
    h = h ^ (h >> np.uint64(31))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat(h * _FACTORS[k] + _SHIFTS[k], starts)
            key = (key ^ (least ^ (least >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out.view(np.int64)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, h, text) -> doc_id, h, cls, fingerprint and the keys of its buckets by MinHash."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cls, fps, keys, ends = [t or "" for t in batch["text"].to_pylist()], [], [], [], [0]
        for a, b in portions(texts):
            every = [np.array(_shingles(t, width), np.uint64) for t in texts[a:b]]
            fps.append(hashes_fingerprints(every))
            sets = [np.unique(x) for x in every]
            cls += [set_class(s) for s in sets]
            ends += list(ends[-1] + np.cumsum([BANDS * (len(s) > 0) for s in sets]))
            if full := [s for s in sets if len(s)]:
                keys.append(band_keys(full).ravel())
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
        fp = pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(cls, pa.int64()), fp, held], names=["doc_id", "h", "cls", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", "h", "text"), each, f"doc_id {kind}, h long, cls long, fp long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """docs with text -> cls and its set."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t or "" for t in batch["text"].to_pylist()], width)
        held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([set_class(s) for s in sets], pa.int64()), held], names=["cls", "shingles"])

    return arrow_pass(docs.select("text"), each, "cls long, shingles array<long>")


def forest(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is linked among sets: each member to the first of its group."""
    sizes = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(at, np.cumsum(sizes)[:-1])
    mark, links, left = np.zeros(at.max() + 1, bool), [], np.arange(len(sets))
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            k = queue.pop()
            # Sets too unequal in size can't be near.
            fit = left[(np.minimum(sizes[left], sizes[k]) * NEAR[1] >= np.maximum(sizes[left], sizes[k]) * NEAR[0])]
            if not len(fit):
                continue
            mark[own[k]] = True
            starts = np.concatenate([[0], np.cumsum(sizes[fit])[:-1]])
            both = np.add.reduceat(mark[np.concatenate([own[i] for i in fit])].astype(np.int64), starts)
            mark[own[k]] = False
            reached = fit[both * NEAR[1] >= (sizes[fit] + sizes[k] - both) * NEAR[0]]
            links += [(names[root], names[i]) for i in reached]
            queue += list(reached)
            left = left[~np.isin(left, reached)]
    return links


def similar(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """classes (cls, h, fp) -> cls, h, key: buckets of the classes whose fingerprints reach each other."""
    classes = save(spark, classes, "jaccard-classes")
    prints = save(spark, classes.select("fp").distinct(), "jaccard-fingerprints")
    roots = components(spark, save(spark, fingerprint_links(spark, prints, MOST), "jaccard-similar"))
    held = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return held.select("cls", "h", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))


def linked(spark: SparkSession, docs: DataFrame, prints: DataFrame, width: int) -> DataFrame:
    """docs (h, text) and their prints -> a, b: links of spanning forests of classes."""
    classes = prints.filter(F.size("keys") > 0).groupBy("cls").agg(F.min(F.struct("h", "fp", "keys")).alias("k")).select("cls", "k.h", "k.fp", "k.keys")
    rows = classes.select("cls", "h", F.explode("keys").alias("key"))
    rows = save(spark, rows.unionByName(similar(spark, classes.select("cls", "h", "fp"))), "jaccard-rows")
    # Buckets of the same members (by their number and 128 bits of them) are searched once.
    members = [F.bit_xor(F.xxhash64("cls", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2)]
    shared = rows.groupBy("key").agg(F.count("*").alias("count"), *members).filter("count > 1")
    shared = shared.groupBy("count", "members1", "members2").agg(F.min("key").alias("key")).select("key", "count")
    rows = save(spark, rows.join(shared, "key"), "jaccard-shared")
    # Texts stay where they are while the hashes wanted are few enough to send to every task; else both are shuffled.
    wanted = save(spark, rows.select("h").distinct(), "jaccard-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = docs.join(wanted, "h", "left_semi").dropDuplicates(["h"])
    sets = save(spark, _sets(texts, width), "jaccard-sets")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A block meets every block of its bucket, itself among them.
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("block", "with") * 65536 + F.greatest("block", "with")
    rows = rows.select("key", pair.cast("long").alias("pair"), "cls").join(sets, "cls")
    rows = rows.select("key", "pair", "cls", "shingles").repartition("key", "pair").sortWithinPartitions("key", "pair", "cls")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, sets = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            links = forest(names, sets) if len(names) > 1 else []
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, pair, cls, own in zip(*[batch[c].to_pylist() for c in ("key", "pair", "cls")], batch["shingles"], strict=True):
                if (key, pair) != held:
                    yield from found()
                    held, names, sets = (key, pair), [], []
                names.append(cls)
                sets.append(own.values.to_numpy(zero_copy_only=False).copy())  # else the whole batch stays
        yield from found()

    return in_arrow(rows, search, "a long, b long").distinct()


def distinct_documents(spark: SparkSession, docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs of each component: the smallest id (none: last), then the smallest hash of the text."""
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints = save(spark, _prints(own, width), "jaccard-prints")
    links = save(spark, linked(spark, own.select("h", "text"), prints, width), "jaccard-links")
    roots = components(spark, links).select(F.col("node").alias("cls"), "root")
    # Of each class first, so that a large group of copies is one row.
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("k")
    first = prints.groupBy("cls").agg(order).join(roots, "cls", "left")
    first = first.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("k").alias("k"))
    first = first.select(F.col("k.doc_id").alias("k_id"), F.col("k.h").alias("k_h"))
    held = docs.withColumn("k_own", F.xxhash64("text"))
    held = held.join(first, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_own") == F.col("k_h")), "left_semi")
    return held.dropDuplicates(["doc_id", "k_own"]).select(*docs.columns)
