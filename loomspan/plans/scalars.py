"""Queries over scalar functions, markup sync points, histograms and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codecs, scalars
from .base import PACKETS, packets, query, table


def tags(spark: SparkSession, d: str) -> DataFrame:
    """pages' tags as sync points: a `<` before a letter; size up to the next, exact if there is one.

    The text is split at `<` once; places are running lengths, so nothing is scanned twice.
    """
    p = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("total"), F.posexplode(F.split("html", "<")).alias("n", "piece"))
    by = Window.partitionBy("page_id").orderBy("n")
    p = p.withColumn("pos", F.coalesce(F.sum(F.length("piece") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long") - 1)
    p = p.filter((F.col("n") > 0) & F.substring("piece", 1, 1).rlike("^[a-z]"))
    nxt = F.lead("pos").over(by)
    return p.select("page_id", "pos", (F.coalesce(nxt, F.col("total")) - F.col("pos")).alias("size"), nxt.isNotNull().alias("exact"), F.ascii(F.substring("piece", 1, 1)).alias("code"))


_TAGS = """o AS (SELECT page_id, html, length(html)::BIGINT AS total, unnest(range(0, length(html) - 1)) AS pos FROM pages),
s AS (SELECT page_id, total, pos, substr(html, pos + 2, 1) AS c FROM o WHERE substr(html, pos + 1, 1) = '<' AND regexp_matches(substr(html, pos + 2, 1), '[a-z]')),
tags AS (SELECT page_id, pos, coalesce(lead(pos) OVER w, total) - pos AS size, lead(pos) OVER w IS NOT NULL AS exact, ascii(c) AS code FROM s WINDOW w AS (PARTITION BY page_id ORDER BY pos))"""


@query(f"WITH {_TAGS} SELECT page_id, pos FROM tags")
def sync_points_pages(spark: SparkSession, d: str) -> DataFrame:
    """Places of opening tags."""
    return tags(spark, d).select("page_id", "pos")


@query(f"WITH {_TAGS} SELECT page_id, pos, size, exact FROM tags")
def nal_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of units: up to the next sync point, or to the end."""
    return tags(spark, d).select("page_id", "pos", "size", "exact")


@query(f"WITH {_TAGS} SELECT code & 31 AS kind, count(*)::BIGINT AS total, count(*) FILTER (WHERE size >= 40)::BIGINT AS matched, round(100.0 * count(*) FILTER (WHERE size < 40) / count(*), 6)::DOUBLE AS miss_percent FROM tags GROUP BY code & 31")
def nal_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Units by the low five bits of their first byte."""
    t = tags(spark, d).groupBy(F.col("code").bitwiseAND(F.lit(31)).alias("kind"))
    return t.agg(F.count("*").alias("total"), F.count_if(F.col("size") >= 40).alias("matched"), F.round(100.0 * F.count_if(F.col("size") < 40) / F.count("*"), 6).alias("miss_percent"))


@query(f"WITH {_TAGS} SELECT CASE WHEN size < 64 THEN 0 WHEN size < 128 THEN 1 WHEN size < 1024 THEN 2 WHEN size < 32768 THEN 3 ELSE 4 END AS bucket, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM tags GROUP BY 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Units by size."""
    return tags(spark, d).groupBy(scalars.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT page_id, unnest(range(0, length(html), 2048)) AS pos, 2048 AS step FROM pages UNION ALL SELECT page_id, unnest(range(0, length(html), 8)), 8 FROM pages")
def stride_points(spark: SparkSession, d: str) -> DataFrame:
    """Fixed strides: wide for the index, narrow for the probe."""
    p = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n")).filter("n > 0")
    at = lambda n, step: p.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))).alias("pos"), F.lit(step).alias("step"))
    return at(F.col("n"), 2048).unionByName(at(F.col("n"), 8))


@query(
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey * 3 % 6000 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x <= 0 THEN 64 ELSE greatest(32, least(4096, x)) END AS win, x % 700 + CASE WHEN x <= 0 THEN 64 ELSE greatest(32, least(4096, x)) END <= 2048 AS fits FROM w"""
)
def window_fits(spark: SparkSession, d: str) -> DataFrame:
    """Window sizes within bounds, and whether a window fits behind an offset."""
    x = F.col("l_partkey") * 3 % 6000
    win = scalars.clamp_window(x).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", win.alias("win"), (x % 700 + win <= 2048).alias("fits"))


@query(
    """WITH b AS (SELECT p_partkey, p_retailprice, p_size, (p_partkey * p_partkey * 977)::BIGINT AS n FROM part)
SELECT p_partkey, format('{:,}', n) AS grouped,
  CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS sized,
  printf('%02d:%02d:%02d', (n % 90000) // 3600, (n % 90000) // 60 % 60, n % 60) AS duration,
  CASE WHEN p_size = 1 THEN 'file' ELSE 'files' END AS noun, printf('%o', p_size) AS octal, p_size AS back
FROM b"""
)
def formats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, sizes, durations and modes as text."""
    n = (F.col("p_partkey") * F.col("p_partkey") * 977).cast("long")
    octal = F.conv(F.col("p_size").cast("string"), 10, 8)
    return table(spark, d, "part").select(
        "p_partkey", scalars.format_int(n).alias("grouped"), scalars.format_size(n).alias("sized"), scalars.format_duration(n % 90000).alias("duration"),
        scalars.plural(F.col("p_size"), "file", "files").alias("noun"), octal.alias("octal"), scalars.octal(octal).alias("back"),
    )


@query(
    """WITH p AS (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path FROM pages)
SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS cleaned,
  path <> '' AND NOT list_contains(string_split(path, '/'), '..') AS valid, 'base/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS joined,
  regexp_replace(regexp_replace(array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/'), '-', '\\\\x2d', 'g'), '/', '-', 'g') AS escaped FROM p"""
)
def path_validity(spark: SparkSession, d: str) -> DataFrame:
    """Paths cleaned, checked, joined to a folder, and as one file name."""
    path = F.coalesce(F.try_element_at(F.split(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "://"), F.lit(2)), F.lit(""))
    cleaned = scalars.clean_path(path)
    return table(spark, d, "pages").select("page_id", cleaned.alias("cleaned"), scalars.valid_path(path).alias("valid"), F.substring(scalars.relative_to(path, F.lit("base")), 2, 10_000).alias("joined"), scalars.escape_mountpoint(path).alias("escaped"))


@query(
    """WITH b AS (SELECT p_partkey, p_size % 3 AS fscod, p_partkey % 40 AS code, [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640] AS rates FROM part)
SELECT p_partkey, CASE WHEN code >= 38 THEN 0 ELSE 2 * CASE fscod WHEN 0 THEN 2 * rates[code // 2 + 1] WHEN 2 THEN 3 * rates[code // 2 + 1] ELSE rates[code // 2 + 1] * 320 // 147 + code % 2 END END::INT AS ac3,
  (((p_partkey * 257) % 65536 & 4095) * 2)::INT AS truehd, p_partkey % 2 AS skip, (20 - p_partkey % 2 - (20 - p_partkey % 2) % 2) AS even FROM b"""
)
def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Frame sizes from header codes, and matches aligned to 16-bit samples."""
    head = F.unhex(F.lpad(F.hex(F.col("p_partkey") * 257 % 65536), 4, "0"))
    cut = scalars.lpcm_aligned(F.col("p_partkey"), F.lit(20).cast("long"))
    return table(spark, d, "part").select(
        "p_partkey", scalars.ac3_frame_size(F.col("p_size") % 3, (F.col("p_partkey") % 40).cast("int")).alias("ac3"), scalars.truehd_unit_size(head).alias("truehd"), cut["skip"].alias("skip"), cut["length"].alias("even")
    )


@query("SELECT o_orderkey, hex(encode(o_orderpriority)) AS plain, regexp_replace(hex(encode(o_orderpriority)), '(..)(..)', '\\2\\1', 'g') AS swapped, substr(o_orderpriority, 2, 2) || substr(o_orderpriority, 5, 2) AS gathered FROM orders")
def byte_swap(spark: SparkSession, d: str) -> DataFrame:
    """16-bit byte order, and a gather at a stride."""
    raw = F.encode("o_orderpriority", "UTF-8")
    one = lambda n: F.lit(n)
    return table(spark, d, "orders").select("o_orderkey", F.hex(raw).alias("plain"), F.hex(scalars.swap16(raw)).alias("swapped"), scalars.strided(F.col("o_orderpriority"), one(1), one(2), one(3), one(2)).alias("gathered"))


@query("SELECT l_orderkey, l_partkey AS offset_, l_suppkey AS length_, (l_linenumber % 4)::BIGINT AS source, l_partkey * 1000 + l_suppkey AS source_offset, l_returnflag = 'N' AS is_video, l_returnflag = 'R' AS is_lpcm, 7 AS sub_id FROM lineitem")
def entry_codec(spark: SparkSession, d: str) -> DataFrame:
    """Entries packed in 28 bytes and unpacked again."""
    c = F.col
    flags = scalars.pack_flags(c("l_returnflag") == "N", c("l_returnflag") == "R")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", c("l_partkey").alias("offset"), c("l_suppkey").alias("length"), (c("l_linenumber") % 4).alias("source"),
        (c("l_partkey") * 1000 + c("l_suppkey")).alias("source_offset"), flags.alias("flags"), F.lit(7).alias("sub_id"),
    )
    out = scalars.unpack_entries(scalars.pack_entries(rows, "l_orderkey"), "l_orderkey")
    return out.withColumnsRenamed({"offset": "offset_", "length": "length_"})


@query(f"WITH {PACKETS} SELECT CASE track WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS kind, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE flag = 'N')::BIGINT AS keyframes FROM packets GROUP BY track")
def track_counts(spark: SparkSession, d: str) -> DataFrame:
    """Packets by kind of track."""
    kind = F.when(F.col("track") == 0, "video").when(F.col("track") == 1, "audio").otherwise("subtitle")
    return packets(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("flag") == "N").alias("keyframes"))


@query(f"WITH {PACKETS} SELECT stream, track, sum(size)::BIGINT AS es_size FROM packets GROUP BY stream, track")
def stream_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of elementary streams."""
    return packets(spark, d).groupBy("stream", "track").agg(F.sum("size").alias("es_size"))


@query(f"WITH {PACKETS}, s AS (SELECT track, file, sum(size)::BIGINT AS size FROM packets GROUP BY track, file) SELECT track, file, size FROM (SELECT *, max(size) OVER (PARTITION BY track) AS m FROM s) WHERE size >= m // 10")
def significant_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of at least a tenth of the largest."""
    s = packets(spark, d).groupBy("track", "file").agg(F.sum("size").alias("size"))
    top = F.floor(F.max("size").over(Window.partitionBy("track")) / 10)
    return s.withColumn("least", top).filter("size >= least").select("track", "file", "size")


_DIM = "VALUES " + ", ".join(f"('{c}', '{k}', {f})" for c, k, f in codecs.CODECS)
_NAMES = [c for c, _, _ in codecs.CODECS]


@query(
    f"""WITH fam(codec, class, family) AS ({_DIM}),
t AS (SELECT p_partkey % 25 AS key, p_partkey AS track, [{", ".join(f"'{x}'" for x in _NAMES)}, 'other'][p_size % 17 + 1] AS codec FROM part),
s AS (SELECT s_nationkey::BIGINT AS key, [{", ".join(f"'{x}'" for x in _NAMES)}, 'other'][s_suppkey % 17 + 1] AS codec FROM supplier),
tf AS (SELECT * FROM t JOIN fam USING (codec)), sf AS (SELECT DISTINCT key, class, family FROM s JOIN fam USING (codec))
SELECT key, track, codec, class, family FROM tf WHERE (key, class) IN (SELECT key, class FROM sf) AND (key, class, family) NOT IN (SELECT key, class, family FROM sf)"""
)
def codec_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Tracks without a source codec of their family."""
    names = F.array(*[F.lit(x) for x in [*_NAMES, "other"]])
    t = table(spark, d, "part").select((F.col("p_partkey") % 25).alias("key"), F.col("p_partkey").alias("track"), F.element_at(names, F.col("p_size") % 17 + 1).alias("codec"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("key"), F.element_at(names, (F.col("s_suppkey") % 17 + 1).cast("int")).alias("codec"))
    return codecs.mismatches(t, s, codecs.families(spark)).select("key", "track", "codec", "class", "family")


@query(
    """WITH i(id, codec) AS (VALUES ('V_MPEG2', 'MPEG-2'), ('V_MPEG4/ISO/AVC', 'H.264'), ('A_DTS', 'DTS'), ('A_DTS/LOSSLESS', 'DTS-HD'), ('A_PCM/INT/LIT', 'LPCM'), ('A_AAC/MPEG2/MAIN', 'AAC'), ('V_VP9', NULL))
SELECT p_partkey, id, codec, CASE p_partkey % 5 WHEN 0 THEN 'MPEG-1' WHEN 1 THEN 'MPEG-2' WHEN 2 THEN NULL WHEN 3 THEN 'MPEG Audio' ELSE 'MPEG Audio' END AS ts
FROM part JOIN i ON id = ['V_MPEG2', 'V_MPEG4/ISO/AVC', 'A_DTS', 'A_DTS/LOSSLESS', 'A_PCM/INT/LIT', 'A_AAC/MPEG2/MAIN', 'V_VP9'][p_partkey % 7 + 1]"""
)
def codec_ids(spark: SparkSession, d: str) -> DataFrame:
    """Codecs of Matroska ids and of stream types."""
    ids = F.array(*[F.lit(x) for x in ("V_MPEG2", "V_MPEG4/ISO/AVC", "A_DTS", "A_DTS/LOSSLESS", "A_PCM/INT/LIT", "A_AAC/MPEG2/MAIN", "V_VP9")])
    t = table(spark, d, "part").select("p_partkey", F.element_at(ids, (F.col("p_partkey") % 7 + 1).cast("int")).alias("id"))
    kind = F.element_at(F.array(*[F.lit(x) for x in (0x01, 0x02, 0x77, 0x03, 0x04)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.select("p_partkey", "id", codecs.mkv_codec(F.col("id")).alias("codec"), codecs.ts_codec(kind).alias("ts"))
