"""ZIP packages of stored members: a sequential writer and a reader by byte ranges.

Layout as published in the ZIP application note. Members are stored, never compressed, so a
range of a member is a range of the package; sizes and offsets always carry ZIP64 fields.
"""

from __future__ import annotations

import struct
import zlib

LOCAL, CENTRAL, END64, LOCATOR64, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
DATE = (1 << 5) | 1  # 1980-01-01
U16, U32 = 0xFFFF, 0xFFFFFFFF


class Writer:
    """Writes members one after another to a stream that need not seek (sizes follow the data)."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # flag bit 3: crc and sizes stand in the descriptor behind the data; bit 11: UTF-8 name
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, DATE, 0, U32, U32, len(raw), 20) + raw
                  + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        one = self.members[-1]
        one[2], one[3] = zlib.crc32(data, one[2]), one[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, DATE, crc, U32, U32, len(raw), 28, 0, 0, 0, 0, U32)
                      + raw + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, n, end = self.at - start, len(self.members), self.at
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, U16), min(n, U16), min(size, U32), U32, 0))


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of every stored member; ``read(offset, n)`` gives
    bytes. Parses the end record, its ZIP64 form where there is one, and the central directory."""
    tail_at = max(0, size - 22 - U16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator_at = tail_at + at - 20
    if locator_at >= 0 and (loc := read(locator_at, 20))[:4] == LOCATOR64:
        end64 = read(struct.unpack_from("<Q", loc, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("bad ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, out, p = read(start, length), {}, 0
    for _ in range(n):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("bad central directory")
        method, stored, full, names, extras, notes = (*struct.unpack_from("<H", directory, p + 10), *struct.unpack_from("<IIHHH", directory, p + 20))
        at = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46:p + 46 + names].decode()
        stored, at = _zip64(directory[p + 46 + names:p + 46 + names + extras], full, stored, at)
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = read(at, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"bad local header of {name}")
        out[name] = at + 30 + sum(struct.unpack_from("<HH", head, 26)), stored
        p += 46 + names + extras + notes
    return out


def _zip64(extra: bytes, full: int, stored: int, at: int) -> tuple[int, int]:
    """Stored size and offset, from the ZIP64 extra field where they do not fit 32 bits."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            q = p + 4
            if full == U32:
                q += 8
            if stored == U32:
                stored, q = struct.unpack_from("<Q", extra, q)[0], q + 8
            if at == U32:
                at = struct.unpack_from("<Q", extra, q)[0]
        p += 4 + n
    return stored, at
