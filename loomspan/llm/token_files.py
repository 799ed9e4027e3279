"""Token ids in Parquet: list columns with controlled encodings, row groups and page indexes.

A dataset has two tables.  tokens: one row a document in ascending doc_id order (nulls
first), with part (the range it was written in), local_start (ids before it in its part),
n_tokens and ids, a list of INT32.  parts: ids and documents of every part and the ids before it.
Ids are dictionary-encoded (a vocabulary fits one dictionary page); the other columns of
format version 2 are delta-encoded.  Row groups and pages are small and carry column
indexes, so a reader of some documents or of the lengths alone reads little else.

Null text is an empty text: only the end id.  An empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_pass, gathered, in_arrow
from .tokens import encoder

WRITER = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Bytes of texts that are encoded together, about: each different word of them is looked up once.
GATHERED = 5_000_000
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encode_sorted(docs: DataFrame, path: str, end_id: int = 0, spaced: bool = True) -> DataFrame:
    """docs (doc_id, text) in their order within each partition -> SCHEMA."""
    end = pa.scalar(np.array([end_id], "<u4").tobytes(), pa.large_binary())
    nothing = pa.scalar(b"", pa.large_binary())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in gathered(batches, "text", GATHERED):
            rows = encoder(path, spaced).arrays(batch["text"].fill_null(""))
            _, offsets, values = pc.binary_join_element_wise(rows, end, nothing).buffers()
            edges = np.frombuffer(offsets, np.int64, len(rows) + 1) // 4
            values = np.frombuffer(values, "<i4", edges[-1])
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array(start + edges[:-1]), pa.array(np.diff(edges)), lists],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(edges[-1])

    return in_arrow(docs.select("doc_id", F.spark_partition_id().alias("part"), "text"), each, SCHEMA, keeps=True)


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, spaced: bool = True) -> None:
    """Writes docs (doc_id, text) as a dataset at `path`; equal ids are ordered by text."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encode_sorted(ranged, tokenizer, end_id, spaced).write.options(**WRITER).parquet(f"{path}/tokens")
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a written part
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document: no ids are read."""
    return _placed(spark, path, "doc_id", "n_tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids.  Filters on doc_id reach the pages' indexes."""
    return _placed(spark, path, "doc_id", "n_tokens", "ids")


def _placed(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    parts = spark.read.schema("part int, n_tokens long, n_docs long, base long").parquet(f"{path}/parts").select("part", "base")
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    out = tokens.select("part", "local_start", *columns).join(F.broadcast(parts), "part")  # a row a written part
    return out.select(columns[0], (F.col("local_start") + F.col("base")).alias("start"), *columns[1:])


def checksums(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids -> with ids_crc32 in place of ids: crc32 of the ids as little-endian 32-bit."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch["ids"]
        at = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_pass(df.select("doc_id", "start", "n_tokens", "ids"), each, "doc_id long, start long, n_tokens long, ids_crc32 long")
