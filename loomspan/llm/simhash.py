"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has bit i set if over half of the text's word shingles, repeats counted, have
it set in their XXH64.  Fingerprints link at `most` or fewer differing bits, and a
document's component has all that it reaches by links.

Candidates.  The 64 bits are cut into m segments on a ring.  Two fingerprints within `most`
bits agree on m - most segments at least, so they meet in a bucket of one of the choices of
that many segments.  m grows with the number of different fingerprints, so that buckets stay
small at any size; no pair within the bound is ever missed.  In a bucket, a pair must have a
segment from which every chain of consecutive segments, of any length l, differs in at most
l * most / m bits (the pigeonring principle: some start has that for every pair within the
bound); what is left takes the full Hamming check.

Large groups.  Equal fingerprints are one class, joined to their documents at the end.  A
bucket is searched from one member to the next, each compared only with those that no
earlier one has reached, so a dense group costs little more than a row each, and only the
links of a spanning forest leave the bucket.  A bucket of more than BLOCK classes is cut
into blocks, and each two blocks are searched on their own, over the cluster.

Null text has no words; texts without words have fingerprint 0, linked as any other.
Repeated rows are in one class.  A document without an id counts for nothing in the smallest
id, and gets the component's; it is null if none has one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, in_arrow, portions, save, schema_with
from .components import components

BLOCK = 2048
_LANES = np.uint64(0x0101010101010101)


def _shingles(text: str, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only the six white bytes
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, 42)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def hashes_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints, unsigned, of each text's hashes, repeats among them."""
    out = np.zeros(len(sets), np.uint64)
    owner = np.flatnonzero([len(s) for s in sets])
    if not len(owner):
        return out
    h, count = np.concatenate([sets[i] for i in owner]), np.array([len(sets[i]) for i in owner])
    blocks = [np.arange(a, a + n, 255) for a, n in zip(np.cumsum(count) - count, count, strict=True)]
    first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    at, need = np.concatenate(blocks), count // 2
    for shift in range(8):
        # Eight counters of a byte each; a block has at most 255 hashes.
        lanes = np.add.reduceat((h >> np.uint64(shift)) & _LANES, at)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):
            bit = np.uint64(8 * lane + shift)
            out[owner] |= (sums[:, lane] > need).astype(np.uint64) << bit
    return out


def fingerprint_all(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints, unsigned."""
    return hashes_fingerprints([np.array(_shingles(t, width), np.uint64) for t in texts])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """docs with text -> their other columns and fp, the fingerprint as a signed long."""
    columns = [c for c in docs.columns if c not in ("text", "fp")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        fp = [fingerprint_all(texts[a:b], width) for a, b in portions(texts)]
        fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(fp.view(np.int64))], names=[*columns, "fp"])

    return arrow_pass(docs.select(*columns, "text"), each, schema_with(docs.select(*columns), "fp long"))


def segments(m: int) -> list[int]:
    """Masks of m segments of 64 bits."""
    edges = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def segments_for(classes: int, most: int) -> int:
    """The fewest segments by which a fingerprint meets about 4 others by chance."""
    m = most + 2
    while m < 64 and comb(m, most) * classes > 4 * 2 ** (64 * (m - most) // m):
        m += 1
    return m


def ring(differing: np.ndarray, masks: list[int], most: int) -> np.ndarray:
    """Which XORs have a start whose chains all keep to their budgets."""
    m = len(masks)
    bits = [np.bitwise_count(differing & np.uint64(x)) for x in masks]
    found = np.zeros(len(differing), bool)
    for start in range(m):
        chain, keep = np.zeros(len(differing), np.uint8), ~found
        for n in range(m):
            if not keep.any():
                break
            chain = chain + bits[(start + n) % m]
            keep &= chain <= (n + 1) * most // m
        found |= keep
    return found


def forest(fps: np.ndarray, masks: list[int], most: int) -> list[tuple[int, int]]:
    """Links that connect what is linked in fps (unsigned, sorted, different): each member to the first of its group."""
    links, left = [], fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            differing = left ^ queue.pop()
            near = np.flatnonzero(ring(differing, masks, most))
            near = near[np.bitwise_count(differing[near]) <= most]
            if len(near):
                reached = left[near]
                links += [(root, x) for x in reached]
                queue += list(reached)
                left = np.delete(left, near)
    return links


def linked(spark: SparkSession, classes: DataFrame, most: int) -> DataFrame:
    """classes (fp, different, cheap to read) -> a, b: links of a spanning forest."""
    m = segments_for(classes.count(), most)
    masks = segments(m)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = [signed(sum(c)) for c in combinations(masks, m - most)]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(c)) for c in choices]))
    rows = classes.select("fp", keys.alias("choice", "bits"))
    large = save(spark, rows.groupBy("choice", "bits").count().filter(F.col("count") > BLOCK), "simhash-large")
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    rows = rows.join(large, ["choice", "bits"], "left").withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A block meets every block of its bucket, itself among them.
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    rows = rows.select("choice", "bits", (low * 65536 + high).cast("long").alias("pair"), "fp")
    key = ["choice", "bits", "pair"]
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest = (*key, "fp"), None
        for batch in (*batches, None):
            if batch is not None:
                own = [batch[c].to_numpy(zero_copy_only=False) for c in names]
                rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rest[:3]], axis=0)) + 1
            edges = np.concatenate([[0], new, [len(rest[0])]])
            if batch is not None:  # the last bucket may go on in the next batch
                edges = edges[:-1]
            links = []
            for i in np.flatnonzero(np.diff(edges) > 1):
                links += forest(np.unique(rest[3][edges[i] : edges[i + 1]].view(np.uint64)), masks, most)
            rest = [x[edges[-1] :] for x in rest]
            if links:
                found = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return in_arrow(rows.select(*key, "fp"), search, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """docs with doc_id and text -> their other columns, fp, root (a fingerprint that names the component) and component_id, one row a row."""
    prints = save(spark, fingerprints(docs, width), "simhash-prints")
    classes = save(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(spark, save(spark, linked(spark, classes, most), "simhash-links"))
    classes = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = save(spark, classes.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return prints.join(classes, "fp").select(*[c for c in prints.columns if c not in ("fp", "root", "component_id")], "fp", "root", "component_id")
