"""MPEG program and transport streams as payload ranges of their elementary streams.

Ranges leave here without stream offsets: those are running sums, which
operators.offsets.running_offsets() gives for all files at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import prepare

PACK, SYSTEM, END, PADDING, PRIVATE = 0xBA, 0xBB, 0xB9, 0xBE, 0xBD
RANGES = "file int, stream int, seq long, file_offset long, size long"


def _payload(data: bytes, at: int) -> tuple[int, int]:
    """Header size and payload size of the packet whose start code is at a place."""
    length = int.from_bytes(data[at + 4 : at + 6], "big")
    if data[at + 6] >> 6 == 2:  # MPEG-2
        head = 3 + data[at + 8]
    else:
        k = at + 6
        while k < len(data) and data[k] == 0xFF and k - at - 6 <= 16:
            k += 1
        if data[k : k + 1] and data[k] >> 6 == 1:
            k += 2
        kind = data[k] >> 4 if k < len(data) else 0
        k += {2: 5, 3: 10}.get(kind, int(k < len(data) and data[k] == 0x0F))
        head = k - at - 6
    return 6 + head, max(0, length - head)


def program_stream(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(stream id, file offset, size) of audio, video and private payloads, in order."""
    at = data.find(b"\0\0\1")
    while 0 <= at < len(data) - 9:
        kind, step = data[at + 3], 1
        if kind == PACK:
            step = 14 + (data[at + 13] & 7) if data[at + 4] >> 6 == 1 and at + 14 <= len(data) else 12
        elif kind in (SYSTEM, PADDING):
            step = 6 + int.from_bytes(data[at + 4 : at + 6], "big")
        elif kind == END:
            step = 4
        elif kind == PRIVATE or 0xC0 <= kind <= 0xEF:
            head, size = _payload(data, at)
            yield kind, at + head, size
            step = head + size
        at = data.find(b"\0\0\1", at + max(1, step))


def packet_size(data: bytes) -> tuple[int, int]:
    """Size of a transport packet and the place of its sync byte: (192, 4) or (188, 0), by four syncs in a row."""
    for size, at in ((192, 4), (188, 0)):
        if len(data) > at + 3 * size and all(data[at + k * size] == 0x47 for k in range(4)):
            return size, at
    raise ValueError("no transport stream")


def _sections(data: bytes, size: int, sync: int, pid: int) -> Iterator[bytes]:
    """Whole table sections of a PID, put together over packets."""
    held = b""
    for at in range(sync, len(data) - (size - sync) + 1, size):
        if data[at] != 0x47 or (data[at + 1] & 0x1F) << 8 | data[at + 2] != pid or not data[at + 3] & 0x10:
            continue
        payload = data[at + 4 + (1 + data[at + 4] if data[at + 3] & 0x20 else 0) : at - sync + size]
        if data[at + 1] & 0x40:
            held = payload[1 + payload[0] :] if payload else b""
        elif held:
            held += payload
        if len(held) >= 3 and len(held) >= (n := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            yield held[:n]
            held = b""


def programs(data: bytes) -> list[tuple[int, int]]:
    """(PID, stream type) of the first program's streams."""
    size, sync = packet_size(data)
    for table in _sections(data, size, sync, 0):
        for k in range(8, len(table) - 4, 4):
            if int.from_bytes(table[k : k + 2], "big"):
                pid = int.from_bytes(table[k + 2 : k + 4], "big") & 0x1FFF
                for own in _sections(data, size, sync, pid):
                    out, at = [], 12 + (int.from_bytes(own[10:12], "big") & 0x0FFF)
                    while at + 5 <= len(own) - 4:
                        out.append((int.from_bytes(own[at + 1 : at + 3], "big") & 0x1FFF, own[at]))
                        at += 5 + (int.from_bytes(own[at + 3 : at + 5], "big") & 0x0FFF)
                    return out
    return []


def transport_stream(data: bytes, pids: set[int]) -> Iterator[tuple[int, int, int]]:
    """(PID, file offset, size) of the payloads of some PIDs behind their packet headers, which may go over packets.

    Packets of other PIDs are passed over at once, by their fixed stride.
    """
    size, sync = packet_size(data)
    table = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size)
    pid = (table[:, sync + 1].astype(np.int64) & 0x1F) << 8 | table[:, sync + 2]
    has = (table[:, sync] == 0x47) & (table[:, sync + 3] & 0x10 > 0) & np.isin(pid, list(pids))
    left: dict[int, int] = {}
    for k in np.flatnonzero(has):
        row, own = table[k], int(pid[k])
        at = sync + 4 + (1 + int(row[sync + 4]) if row[sync + 3] & 0x20 else 0)
        if at >= size:
            continue
        if row[sync + 1] & 0x40:
            if size - at < 9 or bytes(row[at : at + 3]) != b"\0\0\1":
                continue
            left[own] = 9 + int(row[at + 8])
        skip = min(left.get(own, 0), size - at)
        left[own] = left.get(own, 0) - skip
        if at + skip < size:
            yield own, int(k) * size + at + skip, size - at - skip


def ranges(blobs: DataFrame, kind: str, pids: tuple[int, ...] = ()) -> DataFrame:
    """blobs (file, bytes), whole files of up to 2 GB -> RANGES; `kind` is program or transport."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(batch["file"].to_pylist(), batch["bytes"], strict=True):
                data = value.as_py()
                own = program_stream(data) if kind == "program" else transport_stream(data, set(pids) or {p for p, _ in programs(data)})
                found = list(own)
                if found:
                    s, o, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(s), pa.int32()), pa.array(s, pa.int32()), pa.array(range(len(s)), pa.int64()), pa.array(o, pa.int64()), pa.array(n, pa.int64())], names=["file", "stream", "seq", "file_offset", "size"])

    prepare(blobs.sparkSession)
    return blobs.select("file", "bytes").mapInArrow(each, RANGES)


def without_user_data(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Video ranges (offset, size) without user data: from 00 00 01 B2 to the next start code of the range."""
    out = []
    for begin, size in ranges:
        end, kept = begin + size, begin
        if end > len(data):
            continue
        while (at := data.find(b"\0\0\1\xb2", kept, end)) >= 0:
            if at > kept:
                out.append((kept, at - kept))
            after = data.find(b"\0\0\1", at + 4, end - 1)
            kept = after if after >= 0 else end
        if kept < end:
            out.append((kept, end - kept))
    return out


def sub_streams(data: bytes, ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(stream id, offset, size) of audio payloads -> by sub-stream, their headers cut off; other kinds are dropped.

    Private payloads name their sub-stream in the first byte: AC-3 and DTS have four bytes of
    header, LPCM seven.
    """
    out = []
    for stream, begin, size in ranges:
        if 0xC0 <= stream <= 0xDF and size > 0:
            out.append((stream, begin, size))
        elif stream == PRIVATE and size >= 4 and begin < len(data):
            sub = data[begin]
            head = 4 if 0x80 <= sub <= 0x8F else 7 if 0xA0 <= sub <= 0xA7 else size
            if size > head:
                out.append((sub, begin + head, size - head))
    return out
