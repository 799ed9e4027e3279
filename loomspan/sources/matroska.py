"""Matroska files as tables of tracks and packets.

    spark.dataSource.register(Matroska)
    spark.read.format("matroska").option("path", pattern).option("table", "packets").load()

A file is read by one task, as each element's place follows from the one before; reading
`tracks` stops at the first track list.
"""

from __future__ import annotations

import glob
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Ids of elements.
EBML, SEGMENT, TRACKS, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1654AE6B, 0x1F43B675
TRACK, NUMBER, UID, KIND, CODEC, PRIVATE = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x63A2
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TOP = {0x114D9B74, 0x1549A966, TRACKS, CLUSTER, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367}
UNKNOWN = -1


def vint(data, at: int, marker: bool) -> tuple[int, int]:
    """A number of variable length at a place and its width; with its marker bit for ids. All ones: UNKNOWN."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, width
    value &= (1 << 7 * width) - 1
    return (UNKNOWN if value == (1 << 7 * width) - 1 else value), width


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin of contents, end of contents) of the elements in a stretch; an unknown size goes to the end."""
    while at < end:
        name, a = vint(data, at, True)
        size, b = vint(data, at + a, False)
        begin = at + a + b
        stop = end if size == UNKNOWN else min(end, begin + size)
        yield name, begin, stop
        at = stop


def _cluster_end(data, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element of the segment's level."""
    while at < end:
        name, a = vint(data, at, True)
        if name in TOP:
            return at
        size, b = vint(data, at + a, False)
        at += a + b + max(size, 0)
    return end


def tracks_of(data, begin: int, end: int) -> Iterator[tuple]:
    for name, a, b in elements(data, begin, end):
        if name == TRACK:
            own = {n: bytes(data[x:y]) for n, x, y in elements(data, a, b)}
            number = lambda n: int.from_bytes(own.get(n, b""), "big")  # noqa: B023, E731
            yield number(NUMBER), number(UID), number(KIND), own.get(CODEC, b"").rstrip(b"\0").decode(), own.get(PRIVATE, b"")


def _block(data, begin: int, end: int, base: int, keyframe: bool | None) -> tuple:
    track, width = vint(data, begin, False)
    at = begin + width
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    return track, base + relative, at + 3, end - at - 3, bool(flags & 0x80) if keyframe is None else keyframe


def packets_of(data, begin: int, end: int) -> Iterator[tuple]:
    """(track, timestamp, offset, size, keyframe) of a cluster; a laced block is one packet."""
    base = 0
    for name, a, b in elements(data, begin, end):
        if name == TIMESTAMP:
            base = int.from_bytes(data[a:b], "big")
        elif name == SIMPLE:
            yield _block(data, a, b, base, None)
        elif name == GROUP:
            for n, x, y in elements(data, a, b):
                if n == BLOCK:
                    yield _block(data, x, y, base, False)


def scan(data, wanted: str) -> Iterator[tuple]:
    """Rows of `tracks` or `packets` of a whole file."""
    size = len(data)
    name, a = vint(data, 0, True)
    if name != EBML:
        raise ValueError("not an EBML file")
    n, b = vint(data, a, False)
    at = a + b + n
    name, a = vint(data, at, True)
    if name != SEGMENT:
        raise ValueError("no segment after the header")
    n, b = vint(data, at + a, False)
    at, end = at + a + b, size if n == UNKNOWN else min(size, at + a + b + n)
    seq = 0
    while at < end:
        name, a = vint(data, at, True)
        n, b = vint(data, at + a, False)
        begin = at + a + b
        stop = (_cluster_end(data, begin, end) if name == CLUSTER else end) if n == UNKNOWN else min(end, begin + n)
        if name == TRACKS and wanted == "tracks":
            yield from tracks_of(data, begin, stop)
            return
        if name == CLUSTER and wanted == "packets":
            for row in packets_of(data, begin, stop):
                yield seq, *row
                seq += 1
        at = stop


SCHEMAS = {
    "tracks": "path string, number int, uid decimal(20,0), kind int, codec_id string, codec_private binary",
    "packets": "path string, seq long, track int, timestamp long, offset long, size long, keyframe boolean",
}


@dataclass
class OneFile(InputPartition):
    path: str


class Matroska(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matroska"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "packets")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(dict(self.options))


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.table = options["path"], options.get("table", "packets")

    def partitions(self) -> list[InputPartition]:
        return [OneFile(f) for f in sorted(glob.glob(self.path))]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        from decimal import Decimal

        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            for row in scan(data, self.table):
                yield (partition.path, row[0], Decimal(row[1]), *row[2:]) if self.table == "tracks" else (partition.path, *row)
