"""The binary form of an interval map: header, source files, 28-byte entries, remainder, checksums.

Little-endian.  Header of 60 bytes: magic (8), version u32, flags u32, size i64, checksum u64,
source type u8, uses stream offsets u8, number of files u16, number of entries u64, place and
size of the remainder i64.  From version 5 on a creator string follows (u16 length), and from
version 7 on every file has a byte that tells whether it is used.  The footer has XXH64 sums
of entries and remainder, and the magic again.  Versions 3, 5 and 7, those without range
maps, are read and written; the magic is a parameter.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.scalars import ENTRY

MAGIC = b"LOOMSPN1"
_HEAD = struct.Struct("<8sIIqQBBHQqq")


def checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data, 0)


@dataclass
class SpanFile:
    size: int
    checksum: int
    files: list[tuple[str, int, int]]  # path, size, checksum
    entries: np.ndarray  # of ENTRY
    remainder: bytes
    creator: str = ""
    source_type: int = 0
    used: list[bool] = field(default_factory=list)


def used_files(entries: np.ndarray, n: int) -> list[bool]:
    held = set(np.unique(entries["source"]).tolist())
    return [k + 1 in held for k in range(n)]


def write(x: SpanFile, magic: bytes = MAGIC) -> bytes:
    version = 7 if x.creator else 3
    creator = struct.pack("<H", len(x.creator.encode())) + x.creator.encode() if x.creator else b""
    used = used_files(x.entries, len(x.files))
    files = b""
    for (path, size, total), is_used in zip(x.files, used, strict=True):
        raw = path.encode()
        files += struct.pack("<H", len(raw)) + raw + struct.pack("<qQ", size, total) + (bytes([is_used]) if version >= 7 else b"")
    entries = x.entries.astype(ENTRY).tobytes()
    place = _HEAD.size + len(creator) + len(files) + len(entries)
    head = _HEAD.pack(magic, version, 0, x.size, x.checksum, x.source_type, 0, len(x.files), len(x.entries), place, len(x.remainder))
    return head + creator + files + entries + x.remainder + struct.pack("<QQ", checksum(entries), checksum(x.remainder)) + magic


def read(data: bytes, magic: bytes = MAGIC, header_only: bool = False) -> SpanFile:
    if len(data) < _HEAD.size:
        raise ValueError("too short")
    own, version, _, size, total, kind, _, n_files, n_entries, place, n_rest = _HEAD.unpack_from(data)
    if own != magic:
        raise ValueError("wrong magic")
    if version not in (3, 5, 7):
        raise ValueError(f"version {version} isn't read")
    at, creator = _HEAD.size, ""
    if version >= 5:
        n = struct.unpack_from("<H", data, at)[0]
        creator, at = data[at + 2 : at + 2 + n].decode(), at + 2 + n
    files, used = [], []
    for _ in range(n_files):
        n = struct.unpack_from("<H", data, at)[0]
        path, at = data[at + 2 : at + 2 + n].decode(), at + 2 + n
        files.append((path, *struct.unpack_from("<qQ", data, at)))
        at += 16
        used.append(bool(data[at]) if version >= 7 else True)
        at += version >= 7
    if at + 28 * n_entries != place:
        raise ValueError("entries don't end where the remainder begins")
    entries = np.zeros(0, ENTRY) if header_only else np.frombuffer(data, ENTRY, n_entries, at)
    rest = b"" if header_only else data[place : place + n_rest]
    return SpanFile(size, total, files, entries, rest, creator, kind, used)


def verify(data: bytes, magic: bytes = MAGIC) -> dict[str, bool]:
    """Whether entries, remainder and the closing magic are as their writer left them."""
    x = read(data, magic)
    sums = struct.unpack_from("<QQ", data, len(data) - 24)
    return {"entries": checksum(x.entries.tobytes()) == sums[0], "remainder": checksum(x.remainder) == sums[1], "magic": data[-8:] == magic}
