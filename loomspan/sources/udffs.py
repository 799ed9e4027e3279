"""UDF images (ECMA-167): their files as physical extents.

    anchor -> volume descriptors -> partitions -> file set -> folders -> allocation descriptors

Physical and metadata partitions are read; a metadata partition's blocks lie in the extents of
its metadata file.
"""

from __future__ import annotations

from collections.abc import Iterator

SECTOR = 2048
#: Descriptor tags.
ANCHOR, PARTITION, LOGICAL, TERMINATOR, FILE_SET, NAME, CHAIN, ENTRY, EXTENDED = 2, 5, 6, 8, 256, 257, 258, 261, 266


def _u(data, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def text(raw: bytes) -> str:
    """An OSTA compressed string: its first byte tells whether characters have 8 or 16 bits."""
    if not raw:
        return ""
    if raw[0] == 8:
        return raw[1:].decode("latin-1")
    return raw[1:].decode("utf-16-be") if raw[0] == 16 else ""


def is_udf(data) -> bool:
    return len(data) >= 257 * SECTOR and _u(data, 256 * SECTOR, 2) == ANCHOR


class Volume:
    def __init__(self, data) -> None:
        if not is_udf(data):
            raise ValueError("no anchor of a UDF volume")
        self.data = data
        starts, logical = {}, None
        size, at = _u(data, 256 * SECTOR + 16, 4), _u(data, 256 * SECTOR + 20, 4) * SECTOR
        for d in range(at, at + size, SECTOR):
            tag = _u(data, d, 2)
            if tag == PARTITION:
                starts[_u(data, d + 22, 2)] = _u(data, d + 188, 4) * SECTOR
            elif tag == LOGICAL:
                logical = d
            elif tag == TERMINATOR:
                break
        if logical is None or not starts:
            raise ValueError("no logical volume")
        self.maps: list[tuple[int, list[tuple[int, int]] | None]] = []  # start, or the extents of a metadata file
        m, pending = logical + 440, []
        for k in range(_u(data, logical + 268, 4)):
            if data[m] == 1:
                self.maps.append((starts[_u(data, m + 4, 2)], None))
            else:
                start = starts[_u(data, m + 38, 2)]
                self.maps.append((start, None))
                if bytes(data[m + 5 : m + 28]).startswith(b"*UDF Metadata Partition"):
                    pending.append((k, start + _u(data, m + 40, 4) * SECTOR, start))
            m += data[m + 1]
        physical = {start: k for k, (start, _) in enumerate(self.maps)}
        for k, entry, start in pending:
            self.maps[k] = (start, self._extents(entry, physical[start]))
        file_set = self._place(*self._long(logical + 248)[1:])
        if _u(data, file_set, 2) != FILE_SET:
            raise ValueError("no file set")
        self.root = (self._place(*self._long(file_set + 400)[1:]), self._long(file_set + 400)[2])

    def _long(self, at: int) -> tuple[int, int, int]:
        """(length with its kind in the top bits, block, partition)"""
        return _u(self.data, at, 4), _u(self.data, at + 4, 4), _u(self.data, at + 8, 2)

    def _place(self, block: int, partition: int) -> int:
        start, extents = self.maps[partition]
        if extents is None:
            return start + block * SECTOR
        left = block * SECTOR
        for a, n in extents:
            if left < n:
                return a + left
            left -= n
        raise ValueError("a block beyond its metadata file")

    def _extents(self, entry: int, partition: int) -> list[tuple[int, int]]:
        """(offset, length) of a file's contents; neighbours are joined, holes have no place and are refused."""
        data, tag = self.data, _u(self.data, entry, 2)
        if tag not in (ENTRY, EXTENDED):
            raise ValueError("no file entry")
        base = 168 if tag == ENTRY else 208
        at = entry + base + 8 + _u(data, entry + base, 4)
        end, left, kind = at + _u(data, entry + base + 4, 4), _u(data, entry + 56, 8), data[entry + 34] & 7
        if kind == 3:
            return [(at, left)]
        width, out = (8 if kind == 0 else 16), []
        while at + width <= end and left > 0:
            length, block = _u(data, at, 4), _u(data, at + 4, 4)
            own = partition if kind == 0 else _u(data, at + 8, 2)
            what, n = length >> 30, length & 0x3FFFFFFF
            if n == 0:
                break
            place = self._place(block, own)
            if what == 3:
                if _u(data, place, 2) != CHAIN:
                    raise ValueError("no further allocation descriptors where they should be")
                at, end = place + 24, place + 24 + _u(data, place + 20, 4)
                continue
            if what:
                raise ValueError("a hole in a file")
            n = min(n, left)
            left -= n
            if out and sum(out[-1]) == place:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((place, n))
            at += width
        return out

    def _folder(self, entry: int, partition: int) -> Iterator[tuple[str, bool, int, int]]:
        """(name, is folder, place of its entry, partition)"""
        raw = b"".join(bytes(self.data[a : a + n]) for a, n in self._extents(entry, partition))
        at = 0
        while at + 38 <= len(raw) and _u(raw, at, 2) == NAME:
            flags, n, skip = raw[at + 18], raw[at + 19], _u(raw, at + 36, 2)
            block, own = _u(raw, at + 24, 4), _u(raw, at + 28, 2)
            if not flags & 12:  # neither deleted nor the parent
                name = text(raw[at + 38 + skip : at + 38 + skip + n])
                yield name, bool(flags & 2), self._place(block, own), own
            at += (38 + skip + n + 3) & ~3

    def files(self, under: str = "") -> Iterator[tuple[str, int, int, int]]:
        """(path, ordinal, offset, length) of every extent of the files under a folder."""
        todo = [("", *self.root)]
        while todo:
            path, entry, partition = todo.pop()
            for name, is_folder, place, own in self._folder(entry, partition):
                full = f"{path}/{name}".lstrip("/")
                if is_folder:
                    todo.append((full, place, own))
                elif full.startswith(under):
                    for k, (a, n) in enumerate(self._extents(place, own)):
                        yield full, k, a, n
