"""Best-fit packing of documents into sequences, in bulk-synchronous rounds over sorted tables.

Documents are cut into pieces only where they are longer than a sequence.  Pieces go by bands
of length, the longest first: over a half of a sequence, over a quarter and so on (BANDS).  A
band takes rounds, and in each

* its pieces and the gaps that may hold one are range-sorted together by size, largest first;
* every range sweeps its own pieces for their successors, the smallest gaps that hold them;
* what a range couldn't place is matched with the nearest larger ranges' gaps that are left:
  conflicts go by rank, the r-th piece taking the r-th such gap, or its share of one that
  surely holds several (_matches(), from counts of each range alone);
* the gaps shrink, and the round repeats with the pieces that are left.

Once no gap that is left holds the smallest of them, they open sequences of their own, again
range by range.  All pieces and gaps stay in tables; the driver sees some numbers a range.
Ranges are bounded in rows whatever the size of the corpus, and equal sizes are dealt to
ranges by a hash, so that no length, however common, makes a range large.  With one range
the result is that of best fit, longest first, piece by piece.

Null text is an empty text: one piece of the end id.  Repeated rows are packed as often as
they come.  An empty table gives no rows.  pack_documents() drops other columns, whatever
their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import in_arrow, portions, save, schema_with
from .tokens import PORTION, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of a range, about (over 4,096 ranges up to 25 times as many); and the bands' lower ends, as parts of a sequence.
RANGE, BANDS = 20_000, (2, 4, 8, 32)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, spaced: bool = False) -> DataFrame:
    """docs (doc_id, text) -> PIECES, with the ids themselves if asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for a, b in portions(texts, PORTION):
                rows = []
                for doc, raw in zip(docs[a:b], encoder(tokenizer, spaced).ids(texts[a:b]), strict=True):
                    raw += end
                    for k in range(-(-len(raw) // (4 * capacity))):
                        own = raw[4 * capacity * k : 4 * capacity * (k + 1)]
                        rows.append((doc, k, capacity * k, len(own) // 4, zlib.crc32(own), own))
                doc, k, start, n, crc, own = zip(*rows, strict=True)
                out = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    out, names = [*out, pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(own), "<i4")))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return in_arrow(docs.select("doc_id", "text"), each, PIECES + ", ids array<int>" * with_ids, keeps=True)


def sweep(lengths: np.ndarray, gaps: np.ndarray, capacity: int, opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best fit of lengths (falling) into gaps: the gap of each (-1: none), its offset, what is left of the gaps, and how many sequences were opened.

    Opened sequences are numbered after the gaps.
    """
    held: dict[int, list[int]] = {}
    for k in np.argsort(-gaps, kind="stable").tolist():
        held.setdefault(int(gaps[k]), []).append(k)
    sizes = sorted(held)
    left = gaps.tolist()
    own, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)] if len(lengths) else []
    for at, end in zip(edges, edges[1:], strict=False):
        n = int(lengths[at])
        while at < end:
            k = bisect_left(sizes, n)
            if k < len(sizes):
                size = sizes[k]
                gap = held[size].pop()
                if not held[size]:
                    del held[size], sizes[k]
            elif opens:
                gap, size = len(left), capacity
                left.append(capacity)
            else:
                break
            many = min(end - at, size // n)
            own[at : at + many] = gap
            offset[at : at + many] = capacity - size + n * np.arange(many)
            at, rest = at + many, size - many * n
            left[gap] = rest
            if rest:
                if rest not in held:
                    held[rest] = []
                    insort(sizes, rest)
                held[rest].append(gap)
    return own, offset, np.array(left, np.int64), len(left) - len(gaps)


def _swept(rows: DataFrame, capacity: int, step: int, opens: bool) -> DataFrame:
    """rows (size, sequence_id of gaps or null, columns of pieces) -> swept rows: with offset of pieces placed, and
    the range's number and the rank there of pieces left (largest first) and of gaps that hold whatever smaller ranges have (smallest first)."""
    n = rows.count() / RANGE
    n = max(1, math.ceil(n / min(25, max(1, n / 4096))))
    tie = F.xxhash64(*rows.columns)
    first = F.col("sequence_id").isNull().alias("is_piece")
    rows = rows.withColumn("is_piece", first).repartitionByRange(n, F.desc("size"), tie).sortWithinPartitions(F.desc("size"), "is_piece", *[c for c in rows.columns if c != "size"])
    kept = [c for c in rows.columns if c not in ("size", "sequence_id", "is_piece")]
    schema = T.StructType([*rows.select("size", "sequence_id", "is_piece", *kept).schema, *T.StructType.fromDDL("offset long, part int, rank long")])
    rows = rows.select("size", "sequence_id", "is_piece", *kept, F.spark_partition_id().alias("part"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part = table["part"][0].as_py()
        size, is_piece = table["size"].to_numpy(), table["is_piece"].to_numpy()
        names = table["sequence_id"].fill_null(0).to_numpy()
        at, gaps = np.flatnonzero(is_piece), np.flatnonzero(~is_piece)
        own, offset, left, opened = sweep(size[at], size[gaps], capacity, opens)
        ids = np.concatenate([names[gaps], (step << 56) + (part << 32) + np.arange(opened)])
        table = table.drop_columns(["part"])
        none = lambda k, kind: pa.nulls(k, kind)
        # Pieces, those that are left with their rank.
        rest = own < 0
        rank = np.cumsum(rest) - 1
        out = table.take(pa.array(at)).set_column(1, "sequence_id", pa.array(ids[own] if len(ids) else own, mask=rest))
        out = out.append_column("offset", pa.array(offset, mask=rest)).append_column("part", pa.array(np.full(len(at), part, np.int32))).append_column("rank", pa.array(rank, mask=~rest))
        yield from out.to_batches(20_000)
        # Gaps.
        fit = np.flatnonzero(left >= size[-1])
        rank = np.zeros(len(left), np.int64)
        rank[fit[np.argsort(left[fit], kind="stable")]] = np.arange(len(fit))
        unfit = np.ones(len(left), bool)
        unfit[fit] = False
        k = len(left)
        columns = {"size": pa.array(left, table.schema.field("size").type), "sequence_id": pa.array(ids), "is_piece": pa.array(np.zeros(k, bool)), "part": pa.array(np.full(k, part, np.int32)), "rank": pa.array(rank, mask=unfit)}
        out = pa.Table.from_arrays([columns.get(f.name, none(k, f.type)) for f in out.schema], schema=out.schema)
        yield from out.filter(pa.array(left > 0)).to_batches(20_000)

    return in_arrow(rows, each, schema)


def _matches(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """ranges: (number, pieces left, longest of them, gaps left, smallest of them), largest sizes first.
    Rows (range of pieces, ranks from, ranks to, range of gaps, first rank there, pieces for each)."""
    open_: list[list[int]] = []
    out = []
    for part, pieces_, longest, gaps, smallest in ranges:
        at = 0
        while at < pieces_ and open_:
            own = open_[-1]
            each = max(1, own[3] // longest)
            many = min(pieces_ - at, each * (own[2] - own[1]))
            out.append((part, at, at + many, own[0], own[1], each))
            at, own[1] = at + many, own[1] + -(-many // each)
            if own[1] == own[2]:
                open_.pop()
        if gaps:
            open_.append([part, 0, gaps, smallest])
    return out


def _aimed(left: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Pieces left (with part and rank) -> with their gap's range and rank there, and their place among its pieces, from rows of _matches();
    null where no row has them.  Each piece is searched for in the rows, of which a range may have as many as there are ranges."""
    top = max(to for _, _, to, _, _, _ in plan) + 1
    part, first, to, g_part, g_first, many = np.array(sorted(plan), np.int64).T  # two rows a range
    keys = part * top + first

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = batch["part"].to_numpy().astype(np.int64), batch["rank"].to_numpy()
            k = np.maximum(np.searchsorted(keys, own * top + np.minimum(rank, top - 1), "right") - 1, 0)
            none = (part[k] != own) | (rank < first[k]) | (rank >= to[k])
            slot = rank - first[k]
            out = [pa.array(g_part[k].astype(np.int32), mask=none), pa.array(g_first[k] + slot // many[k], mask=none), pa.array(slot % many[k], mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "g_part", "g_rank", "slot"])

    return in_arrow(left, each, schema_with(left, "g_part int, g_rank long, slot long"))


def _round(spark: SparkSession, rows: DataFrame, capacity: int, step: int) -> tuple[list[DataFrame], DataFrame, DataFrame, bool]:
    """Placed pieces, pieces left, gaps, and whether another round may place more."""
    kept = [c for c in rows.columns if c not in ("size", "sequence_id")]
    swept = save(spark, _swept(rows, capacity, step, False), "pack-swept")
    is_left = F.col("is_piece") & F.col("sequence_id").isNull()
    is_gap = ~F.col("is_piece") & F.col("rank").isNotNull()
    stats = swept.groupBy("part").agg(F.count(F.when(is_left, 1)), F.max(F.when(is_left, F.col("size"))), F.count(F.when(is_gap, 1)), F.min(F.when(is_gap, F.col("size"))))
    ranges = sorted((r[0], r[1], r[2] or 0, r[3], r[4] or 0) for r in stats.collect())  # a row a range
    placed, left = [swept.filter("is_piece AND sequence_id IS NOT NULL")], swept.filter(is_left)
    gaps = swept.filter("NOT is_piece").select("size", "sequence_id", "part", "rank")
    plan = _matches(ranges)
    if plan:
        aimed = save(spark, _aimed(left.drop("sequence_id", "offset"), plan), "pack-aimed")
        found, left = aimed.filter("g_part IS NOT NULL"), aimed.filter("g_part IS NULL")
        to = gaps.filter("rank IS NOT NULL").select(F.col("part").alias("g_part"), F.col("rank").alias("g_rank"), F.col("size").alias("gap"), "sequence_id")
        past = Window.partitionBy("g_part", "g_rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        found = found.join(to, ["g_part", "g_rank"])
        found = save(spark, found.withColumn("offset", F.lit(capacity) - F.col("gap") + F.coalesce(F.sum("size").over(past), F.lit(0))).select(*swept.columns), "pack-matched")
        placed.append(found)
        taken = found.groupBy("sequence_id").agg(F.sum("size").alias("taken"))
        gaps = gaps.join(taken, "sequence_id", "left").withColumn("size", F.col("size") - F.coalesce("taken", F.lit(0))).filter("size > 0")
    left = left.select("size", F.lit(None).cast("long").alias("sequence_id"), *kept)
    gaps = save(spark, gaps.select("size", "sequence_id"), "pack-gaps") if plan else gaps.select("size", "sequence_id")
    least, most = left.agg(F.min("size")).first()[0], gaps.agg(F.max("size")).first()[0]
    return placed, left, gaps, least is not None and most is not None and least <= most


def pack(spark: SparkSession, cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut (length and other columns), saved or cheap to read again -> with sequence_id and offset."""
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    inner = [f"c{i}" for i in range(len(columns))]  # so that no column has the name of one of the rounds'
    every = cut.select(*columns).toDF(*inner).withColumn("size", F.col(inner[columns.index("length")]).cast("long"))
    as_piece = lambda x: x.select("size", F.lit(None).cast("long").alias("sequence_id"), *inner)
    as_gap = lambda x: x.select("size", "sequence_id", *[F.lit(None).cast(every.schema[c].dataType).alias(c) for c in inner])
    ends = [capacity, *[capacity // b for b in BANDS if capacity // b > 0], 0]
    gaps, placed, step = None, [], 0
    for high, low in zip(ends, ends[1:], strict=False):
        left = as_piece(every.filter((F.col("size") <= high) & (F.col("size") > low)))
        more = gaps is not None
        while more:
            now, small = gaps.filter(F.col("size") > low), gaps.filter(F.col("size") <= low)
            found, left, now, more = _round(spark, left.unionByName(as_gap(now)), capacity, step)
            placed, gaps, step = placed + found, now.unionByName(small), step + 1
        opened = save(spark, _swept(left, capacity, step, True), "pack-opened")
        step += 1
        placed.append(opened.filter("is_piece"))
        own = opened.filter("NOT is_piece").select("size", "sequence_id")
        gaps = own if gaps is None else gaps.unionByName(own)
    out = placed[0].select(*inner, "sequence_id", "offset")
    for x in placed[1:]:
        out = out.unionByName(x.select(*inner, "sequence_id", "offset"))
    return out.toDF(*columns, "sequence_id", "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, **how) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(spark, save(spark, pieces(docs, tokenizer, capacity, **how), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id and tokens; a sequence has few pieces by its capacity."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.col("held.ids")).alias("tokens"))
