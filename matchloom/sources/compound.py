"""Compound files (the container of HWP 5 documents): sector chains, directory tree, small streams.

Offsets and marks are those of the published format. A chain that loops or leaves the file, and a
directory that loops, raise ValueError; no damaged file is read without end.
"""

from __future__ import annotations

import re
import struct
import zlib

# Fixed values of the format.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
NO_ENTRY, LAST_SECTOR = 0xFFFFFFFF, 0xFFFFFFFA
STORAGE, STREAM, ROOT = 1, 2, 5


class Compound:
    """The streams of one compound file, by path."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 20 or not 2 <= small_shift <= shift:
            raise ValueError("odd sector sizes")
        self.sector, self.small = 1 << shift, 1 << small_shift
        directory, _, self.limit, small_fat, _, more, _ = struct.unpack_from("<IIIIIII", data, 48)
        self.fat = self.numbers(self.fat_sectors(more))
        self.small_fat = self.numbers(self.chain(small_fat, self.fat))
        self.entries = self.joined(self.chain(directory, self.fat))
        self.streams = {}
        self.root = b""
        self.walk()

    def at(self, sector: int) -> bytes:
        begin = (sector + 1) * self.sector
        if begin >= len(self.data):
            raise ValueError("a sector beyond the file")
        return self.data[begin : begin + self.sector]

    def joined(self, sectors: list[int]) -> bytes:
        return b"".join(map(self.at, sectors))

    def numbers(self, sectors: list[int]) -> tuple[int, ...]:
        found = self.joined(sectors)
        return struct.unpack(f"<{len(found) // 4}I", found[: len(found) // 4 * 4])

    def fat_sectors(self, more: int) -> list[int]:
        """The sectors of the allocation table: the header's, then those of its continuation."""
        found = list(struct.unpack_from("<109I", self.data, 76))
        seen = set()
        while more < LAST_SECTOR:
            if more in seen:
                raise ValueError("the table's chain loops")
            seen.add(more)
            part = self.numbers([more])
            found += part[:-1]
            more = part[-1] if part else NO_ENTRY
        return [s for s in found if s < LAST_SECTOR]

    def chain(self, start: int, table: tuple[int, ...]) -> list[int]:
        out, seen = [], set()
        while start < LAST_SECTOR:
            if start in seen or start >= len(table):
                raise ValueError("a chain loops or leaves its table")
            seen.add(start)
            out.append(start)
            start = table[start]
        return out

    def entry(self, number: int) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, size)."""
        raw = self.entries[number * 128 : number * 128 + 128]
        if len(raw) < 128:
            raise ValueError("an entry beyond the directory")
        length, kind = struct.unpack_from("<HB", raw, 64)
        name = raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        return (name, kind, *struct.unpack_from("<III", raw, 68), *struct.unpack_from("<IQ", raw, 116))

    def walk(self) -> None:
        """All streams of the tree, from the root's child on."""
        _, kind, _, _, child, start, size = self.entry(0)
        if kind != ROOT:
            raise ValueError("no root")
        self.root = self.joined(self.chain(start, self.fat))[:size]
        waiting, seen = [(child, ())], set()
        while waiting:
            number, above = waiting.pop()
            if number >= LAST_SECTOR:
                continue
            if number in seen:
                raise ValueError("the directory loops")
            seen.add(number)
            name, kind, left, right, child, start, size = self.entry(number)
            waiting += [(left, above), (right, above)]
            if kind == STORAGE:
                waiting.append((child, (*above, name)))
            elif kind == STREAM:
                self.streams[(*above, name)] = (start, size & 0xFFFFFFFF if self.sector == 512 else size)

    def read(self, path: tuple[str, ...]) -> bytes:
        start, size = self.streams[path]
        if size < self.limit:
            parts = [self.root[s * self.small : (s + 1) * self.small] for s in self.chain(start, self.small_fat)]
            return b"".join(parts)[:size]
        return self.joined(self.chain(start, self.fat))[:size]


def body_sections(data: bytes) -> list[bytes]:
    """The body's sections of a HWP 5 document in their order, decompressed if its header says so; sections that don't unpack are left out."""
    box = Compound(data)
    head = box.read(("FileHeader",)) if ("FileHeader",) in box.streams else b""
    packed = bool(head[36] & 1) if len(head) > 36 else True
    number = lambda path: int(re.sub(r"\D", "", path[-1]) or 0)
    out = []
    for path in sorted((p for p in box.streams if p[0] == "BodyText" and len(p) > 1), key=number):
        raw = box.read(path)
        if packed:
            try:
                raw = zlib.decompress(raw, -15)
            except zlib.error:
                continue
        out.append(raw)
    return out
