"""The compressed form of a stream's ranges: variable-length numbers, deltas of gaps, and runs.

The first range is its offset and size.  A range whose gap and size are the usual ones is part
of a run, written as 0 and the number of ranges; any other as the zigzag of its gap's
difference to the usual gap, plus 1, and its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get(data: bytes, at: int) -> tuple[int, int]:
    """A number and the place after it."""
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return n, at


def encode(offsets: np.ndarray, sizes: np.ndarray, gap: int, size: int) -> bytes:
    if not len(offsets):
        return b""
    gaps = offsets[1:] - offsets[:-1] - sizes[:-1]
    usual = (gaps == gap) & (sizes[1:] == size)
    out = [put(int(offsets[0])), put(int(sizes[0]))]
    edges = np.flatnonzero(np.diff(usual.astype(np.int8))) + 1
    for a, b in zip([0, *edges], [*edges, len(usual)], strict=True):
        if a == b:
            continue
        if usual[a]:
            out += [b"\0", put(int(b - a))]
        else:
            for k in range(a, b):
                d = int(gaps[k]) - gap
                out += [put((d << 1 if d >= 0 else (-d << 1) - 1) + 1), put(int(sizes[k + 1]))]
    return b"".join(out)


def decode(data: bytes, gap: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of every range."""
    if not data:
        return
    offset, at = get(data, 0)
    n, at = get(data, at)
    yield offset, n
    end = offset + n
    while at < len(data):
        kind, at = get(data, at)
        if kind == 0:
            many, at = get(data, at)
            for _ in range(many):
                yield end + gap, size
                end += gap + size
        else:
            z = kind - 1
            n, at = get(data, at)
            start = end + gap + (z >> 1 if z % 2 == 0 else -(z >> 1) - 1)
            yield start, n
            end = start + n
