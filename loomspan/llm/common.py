"""What the operators of this package share: tables, shared folders, Arrow passes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import prepare, save, shared_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """The schema of df and the columns of `more` after it; names may hold anything."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def settle() -> None:
    """Gives memory that is free by now back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: bool = False) -> DataFrame:
    """mapInArrow.  keeps: the function asks for held(); what others have left there goes before any other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _held.clear()
        yield from function(batches)
        settle()

    prepare(df.sparkSession)
    return df.mapInArrow(each, schema)


def arrow_pass(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, keeps: bool = False) -> DataFrame:
    """in_arrow for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return in_arrow(df, each, schema, keeps)


_held: dict[str, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks: the last thing asked for alone, so memory doesn't add up over operators."""
    if _held.get("key") != key:
        _held.clear()
        _held.update(key=key, value=make())
    return _held["value"]


def portions(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters together, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in their order, anew in batches of about `most` bytes in a column of texts, one row at least."""
    kept, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(), dtype=np.int64)
        a = 0
        while a < len(ends):
            before = int(ends[a - 1]) if a else 0
            b = min(int(np.searchsorted(ends, before + most - size)) + 1, len(ends))
            kept.append(batch[a:b])
            size += int(ends[b - 1]) - before
            if size >= most:
                yield pa.concat_batches(kept)
                kept, size = [], 0
            a = b
    if kept:
        yield pa.concat_batches(kept)
