"""Places in byte strings where matching starts, as Arrow functions: binary -> array<int>."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Audio sync words, in the order in which they are tried at a place.
AUDIO_WORDS = (b"\x0b\x77", b"\x7f\xfe\x80\x01", b"\xf8\x72\x6f\xba")
PGS_TYPES = frozenset(b"\x14\x15\x16\x17\x80")


def start_codes(data: bytes) -> list[int]:
    """Begins of 00 00 01; nothing in fewer than four bytes."""
    out, at = [], data.find(b"\0\0\1") if len(data) >= 4 else -1
    while at >= 0:
        out.append(at)
        at = data.find(b"\0\0\1", at + 3)
    return out


def nal_starts(data: bytes) -> list[int]:
    """Places after 00 00 01 that are within the data."""
    return [at + 3 for at in start_codes(data) if at + 3 < len(data)]


def prefixed_nals(data: bytes, width: int = 4) -> list[int]:
    """Units behind length prefixes of `width` bytes, up to a length of 0 or one beyond the end."""
    out, at = [], 0
    while at + width < len(data):
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if n == 0 or at >= len(data):
            break
        out.append(at)
        at += n
    return out


def audio_frames(data: bytes) -> list[int]:
    """Sync words of AC-3, DTS and TrueHD, and MPEG audio headers."""
    out = set()
    for word in AUDIO_WORDS:
        at = data.find(word)
        while at >= 0:
            out.add(at)
            at = data.find(word, at + 1)
    at = data.find(b"\xff")
    while at >= 0:
        if at + 2 < len(data) and data[at + 1] & 0xF0 == 0xF0 and data[at + 2] & 0xF0 != 0xF0:
            out.add(at)
        at = data.find(b"\xff", at + 1)
    return sorted(out)


def pgs_segments(data: bytes) -> list[int]:
    """Segments one after another while their types are known."""
    out, at = [], 0
    while at + 3 <= len(data) and data[at] in PGS_TYPES:
        out.append(at)
        at += 3 + int.from_bytes(data[at + 1 : at + 3], "big")
    return out


def all_frames(data: bytes) -> list[int]:
    """Start codes and audio frames in order."""
    return sorted(set(start_codes(data)) | set(audio_frames(data)))


def every(step: int) -> Callable[[bytes], list[int]]:
    return lambda data: list(range(0, len(data), step))


def as_udf(find: Callable[[bytes], list[int]]):
    """find as a function of a binary column."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else find(x) for x in batch.to_pylist()], pa.list_(pa.int32()))

    return apply


#: By name, as a fingerprinter is chosen; more can be added.
FINDERS: dict[str, Callable[[bytes], list[int]]] = {
    "start_codes": start_codes,
    "nal_starts": nal_starts,
    "prefixed_nals": prefixed_nals,
    "audio_frames": audio_frames,
    "pgs_segments": pgs_segments,
    "all_frames": all_frames,
    "lpcm_index": every(2048),
    "lpcm_probe": every(8),
}
