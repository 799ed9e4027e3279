"""Gaps between two matched neighbours, filled from the source stretch between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import prepare

LEAST = 16


def fill(target: bytes, source: bytes, segments: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (begin, end, source begin) of at least `least` bytes that segments of the target share with the source, in order.

    The target may hold bytes that the source lacks: where they differ, the target goes on to
    the next place that has the source's byte.  A run ends with its segment.
    """
    t, s = np.frombuffer(target, np.uint8), np.frombuffer(source, np.uint8)
    out, at = [], 0
    for begin, end in segments:
        place = begin
        while at < len(s) and (place := target.find(source[at : at + 1], place, end)) >= 0:
            n = min(end - place, len(s) - at)
            differs = np.flatnonzero(t[place : place + n] != s[at : at + n])
            run = int(differs[0]) if len(differs) else n
            if run >= least:
                out.append((place, place + run, at))
            place, at = place + run, at + run
    return out


def fill_gaps(gaps: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """gaps (key, gap_s, source_s, target, source), the bytes of both stretches -> key, s, e, src of the runs found."""

    def each(batches):
        for batch in batches:
            rows = []
            for k, a, b, t, s in zip(*[batch[c].to_pylist() for c in (key, "gap_s", "source_s", "target", "source")], strict=True):
                rows += [(k, a + x, a + y, b + z) for x, y, z in fill(t, s, [(0, len(t))], least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[key, "s", "e", "src"])

    prepare(gaps.sparkSession)
    return gaps.select(key, "gap_s", "source_s", "target", "source").mapInArrow(each, f"`{key}` long, s long, e long, src long")
