"""XXH64 with seed 0, of values and of files in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import prepare


@F.arrow_udf(LongType())
def xxh64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of a binary or string column, as a signed long."""
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        yield pa.array([None if x is None else signed(xxh64_intdigest(x, 0)) for x in batch.to_pylist()], pa.int64())


def file_checksums(chunks: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of whole files, chunk by chunk: the sum goes on over chunks in order, so a file is one stream of one task.

    Files are sorted within partitions, and no more than a batch of a file is held at a time.
    """

    def each(batches):
        from xxhash import xxh64 as state

        last, sum_, n = None, None, 0
        done = lambda: pa.RecordBatch.from_pydict({key: [last], "checksum": [f"{sum_.intdigest():016x}"], "size": [n]}, pa.schema([(key, pa.string()), ("checksum", pa.string()), ("size", pa.int64())]))  # noqa: B023, E731
        for batch in batches:
            for k, v in zip(batch[key].to_pylist(), batch[value].to_pylist(), strict=True):
                if sum_ is None or k != last:
                    if sum_ is not None:
                        yield done()
                    last, sum_, n = k, state(seed=0), 0
                sum_.update(v or b"")
                n += len(v or b"")
        if sum_ is not None:
            yield done()

    prepare(chunks.sparkSession)
    rows = chunks.select(F.col(key).cast("string").alias(key), order, value).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(each, f"`{key}` string, checksum string, size long")
