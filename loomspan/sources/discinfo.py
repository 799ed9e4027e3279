"""Codecs that a disc's own metadata lists: title sets of DVDs, clips of Blu-rays."""

from __future__ import annotations

from ..functions.codecs import TS_TYPES

#: Audio coding modes of a DVD's title set.
DVD_AUDIO = {0: "AC3", 2: "MPEG Audio", 3: "MPEG Audio", 4: "LPCM", 6: "DTS"}


def title_set(data: bytes) -> list[str]:
    """Codecs of an IFO file of a title set, each once, video first."""
    if len(data) < 0x244 or data[:12] != b"DVDVIDEO-VTS":
        raise ValueError("not a title set")
    video = {0: "MPEG-1", 1: "MPEG-2"}.get(data[0x200] >> 6)
    slots = [data[0x204 + 8 * i :][:2] for i in range(min(8, int.from_bytes(data[0x202:0x204], "big")))]
    audio = [DVD_AUDIO.get(s[0] >> 5) for s in slots if any(s)]
    return list(dict.fromkeys(c for c in [video, *audio] if c))


def clip(data: bytes) -> list[str]:
    """Codecs of a clip's program information, each once, in order."""
    if len(data) < 16 or data[:4] != b"HDMV":
        raise ValueError("not a clip")
    start = int.from_bytes(data[12:16], "big")
    if not start or start + 6 > len(data):
        raise ValueError("no program information")
    length = int.from_bytes(data[start : start + 4], "big")
    own, at, found = data[start : start + 4 + length], 6, []
    if not length:
        raise ValueError("empty program information")
    for _ in range(own[5]):
        if at + 8 > len(own):
            break
        streams, at = own[at + 6], at + 8
        for _ in range(streams):
            if at + 3 > len(own):
                break
            n = own[at + 2]
            if n and at + 3 < len(own):
                found.append(TS_TYPES.get(own[at + 3]))
            at += 3 + n
    return list(dict.fromkeys(c for c in found if c))
