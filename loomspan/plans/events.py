"""Queries over change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from .base import PACKETS, packets, query, table


def changes(spark: SparkSession, d: str) -> DataFrame:
    """events with ts as an instant."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS sources, CASE WHEN event_type IN ('click', 'view') THEN 'refresh' ELSE 'integrity' END AS action FROM events GROUP BY event_type")
def change_filter(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of change, and whether they check contents or only refresh times."""
    action = F.when(F.col("event_type").isin("click", "view"), "refresh").otherwise("integrity")
    return changes(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sources")).withColumn("action", action)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'disable' ELSE CASE WHEN user_id % 7 = 0 THEN 'disable' WHEN user_id % 5 <> event_id % 5 THEN 'disable' WHEN event_id % 300 >= 256 THEN 'disable' ELSE 'verify' END END AS outcome FROM events")
def policy_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What each change leads to under its policy."""
    e, u = F.col("event_id"), F.col("user_id")
    policy = F.when(e % 3 == 0, "warn").when(e % 3 == 1, "disable").otherwise("checksum")
    return changes(spark, d).select("event_id", events.outcome(policy, u % 7 != 0, u % 5, e % 5, e % 300).alias("outcome"))


_SESSIONS = """b AS (SELECT {k}, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {gap} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY {k} ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)"""


@query(f"WITH {_SESSIONS.format(k='user_id', gap='6 HOUR')} SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*)::BIGINT AS n FROM g GROUP BY user_id, s")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a source in batches six idle hours apart."""
    s = events.sessions(changes(spark, d), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query(f"WITH {_SESSIONS.format(k='event_type', gap='30 MINUTE')} SELECT event_type, epoch_us(min(ts)) AS first_us, count(*)::BIGINT AS n FROM g GROUP BY event_type, s")
def config_debounce(spark: SparkSession, d: str) -> DataFrame:
    """The same, for kinds of change."""
    s = events.sessions(changes(spark, d), "event_type", "ts", "30 minutes")
    return s.select("event_type", F.unix_micros("first").alias("first_us"), "n")


@query()
def debounce_max_delay(spark: SparkSession, d: str) -> DataFrame:
    """Batches six idle hours apart, but at most a day after their first change."""
    return events.bounded_batches(changes(spark, d), "user_id", "ts", 6 * 3600.0, 24 * 3600.0)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def pending_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One pending check a source and day."""
    return events.first_pending(changes(spark, d), "user_id", F.date_trunc("day", "ts"), "ts", "event_id").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE (user_id, day(ts)::INT // 10) IN (SELECT user_id, max(day(ts)::INT // 10) FROM events GROUP BY user_id)")
def generation_fence(spark: SparkSession, d: str) -> DataFrame:
    """Events of the current generation of their source."""
    e = changes(spark, d).withColumn("generation", F.floor(F.dayofmonth("ts") / 10))
    return events.fence(e, e.groupBy("user_id").agg(F.max("generation").alias("generation")), "user_id", "generation").select("event_id", "user_id")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_writer(spark: SparkSession, d: str) -> DataFrame:
    """The last writer wins."""
    return events.latest(changes(spark, d), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT user_id, bool_and(value > 5) AS enabled, count(*)::BIGINT AS sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def checksum_state(spark: SparkSession, d: str) -> DataFrame:
    """A file is enabled if all its sources passed their last check."""
    e = changes(spark, d).withColumn("k", F.struct("user_id", "event_type"))
    last = events.latest(e, "k", ["ts", "event_id"], ["value"]).select("k.user_id", "k.event_type", "value")
    return events.enabled(last, "user_id", F.col("value") > 5)


@query("SELECT user_id, event_id, mtime FROM (SELECT user_id, event_id, day(ts)::INT AS mtime, lag(day(ts)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> mtime")
def mtime_changes(spark: SparkSession, d: str) -> DataFrame:
    """Polls that see another time than the last."""
    e = changes(spark, d).withColumn("mtime", F.dayofmonth("ts"))
    return events.changes(e, "user_id", ["ts", "event_id"], "mtime").select("user_id", "event_id", "mtime")


_BATCHES = f"""{PACKETS},
b AS (SELECT file AS track, stream AS batch, bool_or(seq = 0 AND size < 10) AS head_missed, max(CASE WHEN size > 25 THEN size END) AS tail FROM packets GROUP BY file, stream)"""


@query(f"WITH {_BATCHES}, h AS (SELECT *, last_value(CASE WHEN tail IS NOT NULL THEN batch END IGNORE NULLS) OVER w AS from_batch, last_value(tail IGNORE NULLS) OVER w AS hint FROM b WINDOW w AS (PARTITION BY track ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT track, batch, from_batch, hint FROM h WHERE head_missed AND hint IS NOT NULL")
def edge_retry(spark: SparkSession, d: str) -> DataFrame:
    """Misses at the head of a batch, with the state of the batch before."""
    p = packets(spark, d).groupBy(F.col("file").alias("track"), F.col("stream").alias("batch"))
    b = p.agg(F.bool_or((F.col("seq") == 0) & (F.col("size") < 10)).alias("head_missed"), F.max(F.when(F.col("size") > 25, F.col("size"))).alias("tail"))
    return events.edge_retry(b, "track").select("track", "batch", "from_batch", "hint")


@query(
    f"""WITH {PACKETS},
p AS (SELECT stream, seq, size * 4 AS size, coalesce(sum(size * 4) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pt, track FROM packets),
m AS (SELECT stream, pt + size AS pt, pt + size AS t_end, pt + size + 1000 AS src_end FROM p WHERE track = 0),
q AS (SELECT p.stream, p.pt, p.size, max(m.pt) AS t_end FROM p JOIN m ON m.stream = p.stream AND m.pt <= p.pt WHERE p.track > 0 AND p.size >= 64 GROUP BY ALL)
SELECT stream, pt, t_end + 1000 + pt - t_end + s AS src FROM (SELECT *, unnest(range(-3, 4)) AS s FROM q) WHERE pt - t_end <= 2 * size"""
)
def locality_asof(spark: SparkSession, d: str) -> DataFrame:
    """Places that the last match predicts for a packet."""
    from ..operators.offsets import running_offsets

    p = packets(spark, d).withColumn("size", F.col("size") * 4)
    p = running_offsets(p, ["stream"], ["seq"], "size", "pt")
    end = F.col("pt") + F.col("size")
    m = p.filter("track = 0 AND size > 0").select("stream", end.alias("pt"), end.alias("t_end"), (end + 1000).alias("src_end"))
    return events.locality(p.filter("track > 0").select("stream", "pt", "size"), m, "stream", "pt")
