"""Streams give what the batch forms give."""

from loomspan.operators import events
from loomspan.streaming import changes
from pyspark.sql import functions as F

SCHEMA = "k long, v long, ts timestamp"


def rows(spark, tmp_path):
    data = [(k, (i * 7 + k) % 3, i * 40.0 + k) for i in range(30) for k in range(3)] + [(9, 0, 1e6)]
    df = spark.createDataFrame(data, "k long, v long, t double").select("k", "v", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_sessions(spark, tmp_path):
    batch, stream = rows(spark, tmp_path)
    want = {tuple(r) for r in events.sessions(batch, "k", "ts", "30 seconds").collect()}
    got = {tuple(r) for r in run(changes.sessions(stream, "k", "ts", "30 seconds", "1 minute"), "sessions", tmp_path)}
    assert got and got <= want and len(want) - len(got) <= 4  # those at the end are still open


def test_pending(spark, tmp_path):
    _, stream = rows(spark, tmp_path)
    got = run(changes.first_pending(stream, "k", "ts", "1 hour"), "pending", tmp_path)
    assert sorted(r.k for r in got) == [0, 1, 2, 9]


def test_changes(spark, tmp_path):
    batch, stream = rows(spark, tmp_path)
    want = {(r.k, r.v) for r in events.changes(batch, "k", ["ts"], "v").collect()}
    got = run(changes.changes(stream, "k", "v", "ts"), "changes", tmp_path)
    assert {(r.k, r.v) for r in got} == want and len(got) == events.changes(batch, "k", ["ts"], "v").count()


def test_sinks(spark, tmp_path):
    batch, _ = rows(spark, tmp_path)
    merge = changes.last_writer_sink(f"{tmp_path}/table", "k", ["ts"], ["v"])
    merge(batch.filter("v = 0"), 0)
    merge(batch.filter("v > 0"), 1)
    got = {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/table/v1").collect()}
    assert got == {(r.k, r.v) for r in events.latest(batch, "k", ["ts"], ["v"]).collect()}
    said = []
    changes.notify_sink(said.append, "k", "v")(batch.limit(3).withColumn("k", F.col("k").cast("string")).withColumn("v", F.col("v").cast("string")), 0)
    assert len(said) == 1 and ": " in said[0]
