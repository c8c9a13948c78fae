"""ZIP archives with stored members: a streaming writer and a reader of directories, both with ZIP64.

The writer never seeks back (object stores cannot), so sizes stand in a data
descriptor and in the central directory.  The reader parses the end record, the
ZIP64 end record where there is one, and the central directory, and gives the byte
range of each stored member.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_END64 = struct.Struct("<4sQ2H2I4Q")
_LOCATOR = struct.Struct("<4sIQI")
_BIG, _MANY = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    """A member and where its header and bytes lie."""

    name: str
    method: int
    size: int
    stored_size: int
    crc: int
    header_offset: int


class StoredZipWriter:
    """Writes stored members to an output stream, one after the other, always with ZIP64 records."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.open = [name, self.at, 0, 0]
        self._put(_LOCAL.pack(b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, _BIG, _BIG, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Append to the open member; returns the position within it."""
        position = self.open[2]
        self._put(data)
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])
        return position

    def end(self) -> None:
        name, offset, size, crc = self.open
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append(Member(name, 0, size, size, crc, offset))
        self.open = None

    def close(self) -> int:
        """Write the directories; returns the archive's size."""
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.stored_size, m.header_offset)
            self._put(_CENTRAL.pack(b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, m.crc, _BIG, _BIG, len(raw), len(extra), 0, 0, 0, 0, _BIG) + raw + extra)
        size, end64 = self.at - start, self.at
        n = len(self.members)
        self._put(_END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR.pack(b"PK\x06\x07", 0, end64, 1))
        self._put(_END.pack(b"PK\x05\x06", _MANY, _MANY, _MANY, _MANY, _BIG, _BIG, 0))
        return self.at


def read_range(source, offset: int, length: int) -> bytes:
    """Exactly that range of a random-access file."""
    source.seek(offset)
    parts = []
    while length > 0:
        data = source.read(length)
        if not data:
            raise EOFError("the archive ends early")
        parts.append(data)
        length -= len(data)
    return b"".join(parts)


def directory(source, size: int) -> list[Member]:
    """Members of an archive, from its central directory alone."""
    tail_at = max(0, size - _END.size - 0xFFFF - _LOCATOR.size)
    tail = read_range(source, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + _END.size > len(tail) or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
    if count == _MANY or length == _BIG or start == _BIG:
        if at < _LOCATOR.size or tail[at - _LOCATOR.size : at - _LOCATOR.size + 4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = _LOCATOR.unpack_from(tail, at - _LOCATOR.size)[2]
        found = _END64.unpack(read_range(source, end64, _END64.size))
        if found[0] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = found[7], found[8], found[9]
    raw, members, at = read_range(source, start, length), [], 0
    for _ in range(count):
        c = _CENTRAL.unpack_from(raw, at)
        if c[0] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, crc, stored, full, n_name, n_extra, n_note, offset = c[4], c[7], c[8], c[9], c[10], c[11], c[12], c[16]
        at += _CENTRAL.size
        name = raw[at : at + n_name].decode("utf-8" if c[3] & 0x0800 else "cp437")
        extra = raw[at + n_name : at + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == _BIG else full
                stored = wide.pop(0) if stored == _BIG else stored
                offset = wide.pop(0) if offset == _BIG else offset
            extra = extra[4 + n :]
        members.append(Member(name, method, full, stored, crc, offset))
        at += n_name + n_extra + n_note
    return members


def stored_range(source, member: Member) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed and can't be read by range")
    head = _LOCAL.unpack(read_range(source, member.header_offset, _LOCAL.size))
    if head[0] != b"PK\x03\x04":
        raise ValueError("bad local header")
    return member.header_offset + _LOCAL.size + head[9] + head[10], member.stored_size
