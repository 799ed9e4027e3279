"""Byte stores: files as rows of chunks, read in parallel ranges by a Python data source.

    spark.dataSource.register(ByteChunks)
    spark.read.format("byte_chunks").option("path", folder).option("chunk", 1 << 20).load()

Paths must be mounted on every executor.  Each chunk carries `overlap` bytes of the next, so
what crosses an edge is seen whole by one of them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    end: int


class ByteChunks(DataSource):
    """Rows (path, size, base, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "byte_chunks"

    def schema(self) -> str:
        return "path string, size long, base long, bytes binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(dict(self.options))


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.chunk = int(options.get("chunk", 1 << 20))
        self.overlap = int(options.get("overlap", 0))
        self.stretch = max(self.chunk, int(options.get("partition", 64 << 20)) // self.chunk * self.chunk)

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "**", "*"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        out = []
        for f in (f for f in files if os.path.isfile(f)):
            n = os.path.getsize(f)
            out += [Stretch(f, a, min(n, a + self.stretch)) for a in range(0, n, self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            n = os.fstat(f.fileno()).st_size
            for base in range(partition.begin, partition.end, self.chunk):
                f.seek(base)
                yield partition.path, n, base, f.read(min(self.chunk, partition.end - base) + self.overlap)


def read_pieces(pieces: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """pieces (request, at, path, offset, length) -> request and its bytes, put together from chunks without overlap."""
    first, last = F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.col("length") - 1) / chunk)
    p = pieces.filter("length > 0").withColumn("n", F.explode(F.sequence(first, last)))
    c = chunks.select("path", F.floor(F.col("base") / chunk).alias("n"), "base", "bytes")
    both = p.join(c, ["path", "n"])
    start = F.greatest(F.col("offset") - F.col("base"), F.lit(0))
    end = F.least(F.col("offset") + F.col("length") - F.col("base"), F.octet_length("bytes").cast("long"))
    part = F.struct("at", "n", F.hex(F.substring(F.col("bytes"), (start + 1).cast("int"), (end - start).cast("int"))).alias("x"))
    held = both.groupBy("request").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a request has few pieces by its length
    return held.select("request", F.unhex(F.array_join(F.col("parts.x"), "")).alias("bytes"))
