"""Queries over interval maps: merge, complement, coalesce, reads, offsets, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals, matching, offsets, rle
from .base import PACKETS, REGIONS, packets, query, regions, sql_complement, sql_merge, table

_MERGED = f"WITH {REGIONS}, {sql_merge('regions', 'target', 'file, is_video', 'ord')}"
_ENTRIES = f"{_MERGED}, sizes AS (SELECT target, max(e) + 25 AS size FROM regions GROUP BY target), {sql_complement('merged', 'sizes', 'target')}"


def merged(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_regions(regions(spark, d), "target", ["file", "is_video"], ["ord"])


def entries(spark: SparkSession, d: str) -> DataFrame:
    sizes = regions(spark, d).groupBy("target").agg((F.max("e") + 25).alias("size"))
    return intervals.complement(merged(spark, d), sizes, "target")


@query(f"{_MERGED} SELECT target, s, e, file, is_video, src FROM merged")
def region_merge(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping regions become disjoint, the earlier winning."""
    return merged(spark, d)


@query(f"{_ENTRIES} SELECT * FROM entries")
def gap_complement(spark: SparkSession, d: str) -> DataFrame:
    """Regions and what they leave out tile every target."""
    return entries(spark, d)


@query(f"{_ENTRIES} SELECT target, count(*)::BIGINT AS pieces, sum(length)::BIGINT AS size, max(mkv_offset + length)::BIGINT AS last FROM entries GROUP BY target")
def tiling(spark: SparkSession, d: str) -> DataFrame:
    """That entries tile: their lengths sum to where the last ends."""
    e = entries(spark, d).groupBy("target")
    return e.agg(F.count("*").alias("pieces"), F.sum("length").alias("size"), F.max(F.col("mkv_offset") + F.col("length")).alias("last"))


_RANGES = f"""{PACKETS},
ranges AS (
  SELECT stream, seq, size, coalesce(sum(size + CASE WHEN track = 0 THEN 8 ELSE 0 END) OVER w, 0)::BIGINT + 4 AS file_offset,
         coalesce(sum(size) OVER w, 0)::BIGINT AS es_offset, track
  FROM packets WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Packets as payload ranges: a header of 8 follows those of track 0."""
    p = offsets.running_offsets(packets(spark, d), ["stream"], ["seq"])
    p = p.withColumn("wide", F.col("size") + F.when(F.col("track") == 0, 8).otherwise(0))
    p = offsets.running_offsets(p, ["stream"], ["seq"], "wide", "file_offset")
    return p.select("stream", "seq", "size", (F.col("file_offset") + 4).alias("file_offset"), "es_offset", "track")


@query(f"WITH {_RANGES} SELECT * FROM ranges")
def es_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running offsets of a stream: the sum of sizes before."""
    return ranges(spark, d)


@query(
    f"""WITH {_RANGES},
kept AS (SELECT stream, track, seq, file_offset + h AS file_offset, size - h AS size FROM (SELECT *, CASE track WHEN 1 THEN 4 ELSE 7 END AS h FROM ranges WHERE track > 0) WHERE size > h)
SELECT stream, track, seq, file_offset, size, coalesce(sum(size) OVER (PARTITION BY stream, track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS es_offset FROM kept"""
)
def es_renumber(spark: SparkSession, d: str) -> DataFrame:
    """Headers of 4 or 7 stripped by sub-stream, one kind dropped, offsets anew."""
    header = F.when(F.col("track") == 1, 4).otherwise(7)
    kept = offsets.strip_and_renumber(ranges(spark, d), F.col("track") > 0, header, ["stream", "track"], ["seq"])
    return kept.select("stream", "track", "seq", "file_offset", "size", "es_offset")


@query(
    f"""WITH {_RANGES},
b AS (SELECT *, CASE WHEN coalesce(lag(file_offset + size) OVER w = file_offset AND lag(es_offset + size) OVER w = es_offset, FALSE) THEN 0 ELSE 1 END AS fresh
  FROM ranges WINDOW w AS (PARTITION BY stream ORDER BY file_offset, es_offset)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY file_offset, es_offset ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT stream, min(file_offset) AS file_offset, sum(size)::BIGINT AS size, min(es_offset) AS es_offset FROM g GROUP BY stream, island"""
)
def range_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that continue each other become one."""
    return intervals.coalesce_adjacent(ranges(spark, d), "stream")


@query(f"WITH {REGIONS} SELECT DISTINCT target, unnest(range(CAST(ceil(s / 16) AS BIGINT), CAST(floor(e / 16) AS BIGINT))) AS chunk FROM regions WHERE ceil(s / 16) < floor(e / 16)")
def coverage_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 16 that one region covers fully."""
    return intervals.covered_chunks(regions(spark, d).select("target", "s", "e"), "target", 16)


_REQUESTS = "requests AS (SELECT o_orderkey AS target, o_custkey % 90 AS r_from, o_custkey % 90 + 40 AS r_to FROM orders)"


@query(
    f"""{_ENTRIES}, {_REQUESTS}
SELECT target, r_from, greatest(mkv_offset, r_from) - r_from AS piece_at, source,
  source_offset + greatest(mkv_offset, r_from) - mkv_offset AS source_offset, least(mkv_offset + length, r_to) - greatest(mkv_offset, r_from) AS length
FROM entries JOIN requests USING (target) WHERE mkv_offset < r_to AND r_from < mkv_offset + length"""
)
def positional_read(spark: SparkSession, d: str) -> DataFrame:
    """Read requests in pieces of the entries that they meet."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), (F.col("o_custkey") % 90).alias("l_s"), (F.col("o_custkey") % 90 + 40).alias("l_e"))
    held = entries(spark, d).select("target", F.col("mkv_offset").alias("r_s"), (F.col("mkv_offset") + F.col("length")).alias("r_e"), "source", "source_offset")
    both = intervals.overlap_join(asked, held, "target", 64)
    start = F.greatest("l_s", "r_s")
    return both.select("target", F.col("l_s").alias("r_from"), (start - F.col("l_s")).alias("piece_at"), "source", (F.col("source_offset") + start - F.col("r_s")).alias("source_offset"), (F.least("l_e", "r_e") - start).alias("length"))


@query(
    f"""{_ENTRIES},
o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mkv_offset) - 1 AS ordinal FROM entries),
b AS (SELECT target, unnest(range(0, (size - 1) // 64 + 1)) AS block FROM sizes)
SELECT b.target, b.block, max(o.ordinal) AS ordinal FROM b JOIN o ON o.target = b.target AND o.mkv_offset <= b.block * 64 GROUP BY b.target, b.block"""
)
def block_index(spark: SparkSession, d: str) -> DataFrame:
    """For each block of 64 of a target, the entry that holds its start."""
    by = Window.partitionBy("target").orderBy("mkv_offset")
    e = entries(spark, d).withColumn("ordinal", F.row_number().over(by).cast("long") - 1)
    sizes = regions(spark, d).groupBy("target").agg((F.max("e") + 25).alias("size"))
    return intervals.blocks_of(e, sizes, "target", 64)


_ASKED = "asked AS (SELECT o_orderkey AS stream, o_orderkey AS region_id, o_custkey % 60 AS es_s, o_custkey % 60 + 50 AS es_e FROM orders)"


@query(
    f"""WITH {_RANGES}, {_ASKED},
p AS (SELECT stream, region_id, es_s, es_e, greatest(es_s, es_offset) AS a, least(es_e, es_offset + size) AS b, file_offset + greatest(es_s, es_offset) - es_offset AS f
  FROM asked JOIN ranges USING (stream) WHERE es_s < es_offset + size AND es_offset < es_e)
SELECT stream, region_id, row_number() OVER (PARTITION BY stream, region_id ORDER BY a, f)::INT - 1 AS piece, f AS file_offset, b - a AS length,
  sum(b - a) OVER (PARTITION BY stream, region_id) = es_e - es_s AS complete FROM p"""
)
def offset_compose(spark: SparkSession, d: str) -> DataFrame:
    """Stream regions as ranges of the file, and whether the map covers them."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), F.col("o_orderkey").alias("region_id"), (F.col("o_custkey") % 60).alias("es_s"), (F.col("o_custkey") % 60 + 50).alias("es_e"))
    return offsets.compose(asked, ranges(spark, d), "stream", 64)


@query(
    f"""WITH {_RANGES}, {_ASKED},
x AS (SELECT stream, unnest(range(0, 6)) AS k FROM (SELECT DISTINCT stream FROM ranges)),
ext AS (SELECT stream, k * 80 AS e_s, k * 80 + 80 AS e_e, 100000 - k * 500 AS base FROM x),
p AS (SELECT stream, region_id, greatest(es_s, es_offset) AS a, least(es_e, es_offset + size) - greatest(es_s, es_offset) AS n, file_offset + greatest(es_s, es_offset) - es_offset AS f
  FROM asked JOIN ranges USING (stream) WHERE es_s < es_offset + size AND es_offset < es_e)
SELECT stream, region_id, a AS es_s, base + greatest(f, e_s) - e_s AS iso_offset, least(f + n, e_e) - greatest(f, e_s) AS length
FROM p JOIN ext USING (stream) WHERE f < e_e AND e_s < f + n"""
)
def extent_compose(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a file that lies in extents, as ranges of the image: two maps composed."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), F.col("o_orderkey").alias("region_id"), (F.col("o_custkey") % 60).alias("l_s"), (F.col("o_custkey") % 60 + 50).alias("l_e"))
    r = ranges(spark, d)
    held = r.select("stream", "file_offset", F.col("es_offset").alias("r_s"), (F.col("es_offset") + F.col("size")).alias("r_e"))
    p = intervals.overlap_join(asked, held, "stream", 64)
    a = F.greatest("l_s", "r_s")
    p = p.select("stream", "region_id", a.alias("es_s"), (F.col("file_offset") + a - F.col("r_s")).alias("f"), (F.least("l_e", "r_e") - a).alias("n"))
    p = p.select("stream", "region_id", "es_s", F.col("f").alias("l_s"), (F.col("f") + F.col("n")).alias("l_e"))
    x = r.select("stream").distinct().select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    x = x.select("stream", (F.col("k") * 80).alias("r_s"), (F.col("k") * 80 + 80).alias("r_e"), (100000 - F.col("k") * 500).alias("base"))
    both = intervals.overlap_join(p, x, "stream", 64)
    start = F.greatest("l_s", "r_s")
    shift = F.when(start == F.col("l_s"), 0).otherwise(start - F.col("l_s"))
    return both.select("stream", "region_id", F.col("es_s").alias("es_s"), (F.col("base") + start - F.col("r_s")).alias("iso_offset"), (F.least("l_e", "r_e") - start).alias("length"), shift.alias("shift")).drop("shift")


@query(
    f"""WITH {_RANGES},
q AS (SELECT o_orderkey AS stream, o_custkey % 150 AS pt FROM orders)
SELECT q.stream, q.pt, r.seq, r.file_offset + q.pt - r.es_offset AS file_offset
FROM q JOIN ranges r ON r.stream = q.stream AND r.es_offset <= q.pt AND q.pt < r.es_offset + r.size"""
)
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The range that holds an offset, by an as-of lookup."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), (F.col("o_custkey") % 150).alias("at"))
    r = ranges(spark, d).filter("size > 0").withColumn("at", F.col("es_offset")).withColumn("end", F.col("es_offset") + F.col("size"))
    out = intervals.as_of(q, r, "stream", "at", ["seq", "file_offset", "es_offset", "end"]).filter(F.col("at") < F.col("end"))
    return out.select("stream", F.col("at").alias("pt"), "seq", (F.col("file_offset") + F.col("at") - F.col("es_offset")).alias("file_offset"))


@query(
    f"""{_ENTRIES}, {PACKETS},
pk AS (SELECT stream AS target, track, coalesce(sum(size + 3) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p_s, size FROM packets),
dl AS (SELECT target, mkv_offset, length FROM entries WHERE source = 0),
ov AS (SELECT dl.target, CASE track WHEN 0 THEN 'video' ELSE 'audio' END AS kind, least(mkv_offset + length, p_s + size) - greatest(mkv_offset, p_s) AS n
  FROM dl JOIN pk ON dl.target = pk.target AND mkv_offset < p_s + size AND p_s < mkv_offset + length),
al AS (SELECT kind, n, 1 AS c FROM ov UNION ALL SELECT 'container', (SELECT sum(length) FROM dl) - (SELECT sum(n) FROM ov), 0)
SELECT coalesce(kind, 'all') AS kind, sum(n)::BIGINT AS bytes, sum(c)::BIGINT AS pieces FROM al GROUP BY GROUPING SETS ((kind), ())"""
)
def delta_classification(spark: SparkSession, d: str) -> DataFrame:
    """What the unmatched stretches consist of: packets by kind, and the container between them."""
    delta = entries(spark, d).filter("source = 0").select("target", F.col("mkv_offset").alias("l_s"), (F.col("mkv_offset") + F.col("length")).alias("l_e"))
    p = packets(spark, d).withColumn("wide", F.col("size") + 3)
    p = offsets.running_offsets(p, ["stream"], ["seq"], "wide", "r_s").withColumn("r_e", F.col("r_s") + F.col("size"))
    p = p.select(F.col("stream").alias("target"), "r_s", "r_e", F.when(F.col("track") == 0, "video").otherwise("audio").alias("kind"))
    met = intervals.overlap_join(delta, p, "target", 64).select("kind", (F.least("l_e", "r_e") - F.greatest("l_s", "r_s")).alias("n"))
    met = met.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("c"))  # a row a kind: what packets hold isn't the container's
    own = lambda kind, n, c: F.struct(kind.alias("kind"), n.alias("n"), c.cast("long").alias("c"))
    met = met.select(F.inline(F.array(own(F.col("kind"), F.col("n"), F.col("c")), own(F.lit("container"), -F.col("n"), F.lit(0)))))
    rest = delta.select(F.lit("container").alias("kind"), (F.col("l_e") - F.col("l_s")).alias("n"), F.lit(0).cast("long").alias("c"))
    out = met.unionByName(rest).rollup("kind").agg(F.sum("n").alias("bytes"), F.sum("c").alias("pieces"))
    return out.select(F.coalesce("kind", F.lit("all")).alias("kind"), "bytes", "pieces")


@query(
    f"""{_ENTRIES}, {PACKETS},
pk AS (SELECT stream AS target, seq, coalesce(sum(size + 3) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p_s, size FROM packets),
dl AS (SELECT target, mkv_offset, length FROM entries WHERE source = 0)
SELECT dl.target, seq, mkv_offset, least(mkv_offset + length, p_s + size) - greatest(mkv_offset, p_s) AS bytes,
  CASE WHEN length < 16 THEN 'slice' ELSE 'whole' END AS kind
FROM dl JOIN pk ON dl.target = pk.target AND mkv_offset < p_s + size AND p_s < mkv_offset + length"""
)
def delta_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched stretches by the packets that they touch."""
    delta = entries(spark, d).filter("source = 0").select("target", F.col("mkv_offset").alias("l_s"), (F.col("mkv_offset") + F.col("length")).alias("l_e"))
    p = packets(spark, d).withColumn("wide", F.col("size") + 3)
    p = offsets.running_offsets(p, ["stream"], ["seq"], "wide", "r_s").withColumn("r_e", F.col("r_s") + F.col("size"))
    met = intervals.overlap_join(delta, p.select(F.col("stream").alias("target"), "seq", "r_s", "r_e"), "target", 64)
    kind = F.when(F.col("l_e") - F.col("l_s") < 16, "slice").otherwise("whole")
    return met.select("target", "seq", F.col("l_s").alias("mkv_offset"), (F.least("l_e", "r_e") - F.greatest("l_s", "r_s")).alias("bytes"), kind.alias("kind"))


_GAPS = f"""{_RANGES},
n AS (SELECT *, lead(file_offset) OVER w - file_offset - size AS gap, file_offset - lag(file_offset + size) OVER w AS before FROM ranges WINDOW w AS (PARTITION BY stream ORDER BY file_offset)),
mg AS (SELECT stream, gap AS v, count(*) AS c FROM n WHERE gap IS NOT NULL GROUP BY stream, gap),
ms AS (SELECT stream, size AS v, count(*) AS c FROM n GROUP BY stream, size),
dg AS (SELECT stream, v FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY c DESC, v) AS r FROM mg) WHERE r = 1),
dz AS (SELECT stream, v FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY c DESC, v) AS r FROM ms) WHERE r = 1),
df AS (SELECT stream, coalesce(dg.v, 0) AS default_gap, dz.v AS default_size FROM dz LEFT JOIN dg USING (stream))"""

_RUNS = f"""{_GAPS},
u AS (SELECT n.*, default_gap, default_size, CASE WHEN coalesce(before = default_gap AND size = default_size, FALSE) THEN 0 ELSE 1 END AS fresh FROM n JOIN df USING (stream)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY file_offset ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM u),
runs AS (SELECT stream, run, min(file_offset) AS file_offset, arg_min(size, file_offset) AS size, coalesce(min(CASE WHEN fresh = 1 THEN before END), 0) AS before, count(*) - 1 AS follow, default_gap, default_size
  FROM v GROUP BY stream, run, default_gap, default_size)"""


@query(f"WITH {_GAPS} SELECT * FROM df")
def mode_gap_size(spark: SparkSession, d: str) -> DataFrame:
    """The usual gap and size of a stream's ranges."""
    return rle.usual_gap_and_size(ranges(spark, d), "stream")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def rle_runs(spark: SparkSession, d: str) -> DataFrame:
    """Ranges in run-length form."""
    r = ranges(spark, d)
    return rle.encode_runs(r, "stream", rle.usual_gap_and_size(r, "stream"))


@query(f"WITH {_RANGES} SELECT stream, file_offset, size FROM ranges")
def rle_expand(spark: SparkSession, d: str) -> DataFrame:
    """Runs expanded again: the ranges themselves."""
    return rle.decode_runs(rle_runs(spark, d), "stream")


@query(f"WITH {_RANGES} SELECT stream, ordinal, file_offset, es_offset FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY file_offset, es_offset) - 1 AS ordinal FROM ranges) WHERE ordinal % 3 = 0")
def coarse_index(spark: SparkSession, d: str) -> DataFrame:
    """Every third range of a stream."""
    return rle.every_nth(ranges(spark, d), "stream", 3)


@query("SELECT l_orderkey, l_linenumber, v, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS coded, ceil(length(bin(CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END)) / 7.0)::INT AS bytes FROM (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey * 20 AS v FROM lineitem)")
def zigzag(spark: SparkSession, d: str) -> DataFrame:
    """Signed numbers as unsigned ones, and the bytes that they take."""
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey") * 20).alias("v"))
    v = v.withColumn("coded", rle.zigzag(F.col("v"))).withColumn("bytes", rle.uvarint_length(F.col("coded")))
    return v.filter(rle.unzigzag(F.col("coded")) == F.col("v"))


@query(f"WITH {PACKETS}, f AS (SELECT *, stream % 100 AS target FROM packets) SELECT target, track, seq, stream, ((row_number() OVER (PARTITION BY target, track ORDER BY stream, seq) - 1) // 64)::BIGINT AS batch FROM f")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Packets of a target's track in batches of 64."""
    p = packets(spark, d).select((F.col("stream") % 100).alias("target"), "track", "seq", "stream")
    return matching.batches(p, ["target", "track"], ["stream", "seq"])


@query(
    f"""{_MERGED},
n AS (SELECT *, lead(s) OVER w AS next_s, lead(src) OVER w AS next_src, lead(file) OVER w AS next_file FROM merged WINDOW w AS (PARTITION BY target ORDER BY s))
SELECT target, e AS gap_s, next_s AS gap_e, src + e - s AS source_s, next_src AS source_e FROM n
WHERE next_s > e AND next_file = file AND next_src > src + e - s"""
)
def gap_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between neighbouring regions of one file, with the gap of the source."""
    by = Window.partitionBy("target").orderBy("s")
    n = merged(spark, d)
    for c in ("s", "src", "file"):
        n = n.withColumn(f"next_{c}", F.lead(c).over(by))
    end = F.col("src") + F.col("e") - F.col("s")
    n = n.withColumn("source_s", end).filter("next_s > e AND next_file = file AND next_src > source_s")
    return n.select("target", F.col("e").alias("gap_s"), F.col("next_s").alias("gap_e"), "source_s", F.col("next_src").alias("source_e"))


@query(f"{_ENTRIES} SELECT source, count(*)::BIGINT AS n, sum(length)::BIGINT AS bytes, count(DISTINCT target)::BIGINT AS targets FROM entries WHERE source > 0 GROUP BY source")
def used_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that entries use."""
    e = entries(spark, d).filter("source > 0")
    return e.groupBy("source").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.countDistinct("target").alias("targets"))


@query(
    f"""{_ENTRIES}, f AS (SELECT target, sum(size)::BIGINT AS size, sum(CASE WHEN source = 0 THEN length ELSE 0 END)::BIGINT AS delta FROM (SELECT target, length AS size, source, length FROM entries) GROUP BY target),
g AS (SELECT o_orderpriority AS grp, target, size, delta FROM f JOIN orders ON o_orderkey = target)
SELECT coalesce(grp, 'all') AS grp, count(*)::BIGINT AS files, sum(size)::BIGINT AS size, sum(delta)::BIGINT AS delta, round(100.0 * (sum(size) - sum(delta)) / sum(size), 6)::DOUBLE AS savings
FROM g GROUP BY ROLLUP (grp) HAVING count(*) >= 2"""
)
def stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Savings by group and over all."""
    f = entries(spark, d).groupBy("target").agg(F.sum("length").alias("size"), F.sum(F.when(F.col("source") == 0, F.col("length")).otherwise(0)).alias("delta"))
    g = f.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("grp")), "target")
    out = g.rollup("grp").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("delta").alias("delta")).filter("files >= 2")
    return out.select(F.coalesce("grp", F.lit("all")).alias("grp"), "files", "size", "delta", F.round(100.0 * (F.col("size") - F.col("delta")) / F.col("size"), 6).alias("savings"))
