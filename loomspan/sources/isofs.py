"""ISO 9660 images: their files as extents, and what kind of disc an image or a folder is."""

from __future__ import annotations

import glob
import mmap
import os
from collections.abc import Iterator

BLOCK = 2048


def _root(data) -> tuple[int, int]:
    at = 16 * BLOCK
    if data[at] != 1 or bytes(data[at + 1 : at + 6]) != b"CD001":
        raise ValueError("no primary volume descriptor")
    return _extent(data, at + 156)


def _extent(data, at: int) -> tuple[int, int]:
    number = lambda k: int.from_bytes(data[at + k : at + k + 4], "little")
    return number(2) * BLOCK, number(10)


def _folder(data, begin: int, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, flags, begin, size) of a directory's records, however many; none goes over the end of a block.

    ValueError where a record goes over the directory's end or has no room for its name.
    """
    at, end = begin, begin + size
    if end > len(data):
        raise ValueError(f"a directory of {size} bytes at {begin} goes over the image's end")
    while at < end:
        n = data[at]
        if n == 0:
            at = (at // BLOCK + 1) * BLOCK
            continue
        wide = data[at + 32] if n > 33 else 0
        if not wide or 33 + wide > n or at + n > end:
            raise ValueError(f"a broken directory record at {at}")
        name = bytes(data[at + 33 : at + 33 + wide])
        if name not in (b"\0", b"\1"):
            yield name.decode("latin-1").split(";")[0].rstrip("."), data[at + 25], *_extent(data, at)
        at += n


def files(data, under: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, begin, size) of every extent of an image's files, in order; a file of several has one row each.

    under: the paths' beginning, in capitals or not.  A folder that holds itself is read once.
    """
    seen = set()
    todo = [("", *_root(data))]
    while todo:
        path, begin, size = todo.pop()
        if begin in seen:
            continue
        seen.add(begin)
        for name, flags, a, n in _folder(data, begin, size):
            own = f"{path}/{name}".lstrip("/")
            if flags & 2:
                todo.append((own, a, n))
            elif own.upper().startswith(under.upper()):
                yield own, a, n


def kind_of_image(data) -> str:
    """bluray or dvd by the folders at the root; what can't be read counts as a dvd."""
    try:
        names = {name.upper() for name, flags, _, _ in _folder(data, *_root(data)) if flags & 2}
    except (ValueError, IndexError):
        return "dvd"
    return "bluray" if "BDMV" in names else "dvd"


def kind_of_folder(folder: str) -> str:
    """By its first image, else by its media files."""
    images = sorted(glob.glob(os.path.join(folder, "*.iso")) + glob.glob(os.path.join(folder, "*", "*.iso")))
    if images:
        if not os.path.getsize(images[0]):
            return "dvd"
        with open(images[0], "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return kind_of_image(data)
    if glob.glob(os.path.join(folder, "BDMV", "STREAM", "*.m2ts")):
        return "bluray"
    raise ValueError(f"{folder}: no disc image and no transport streams")
