"""ZIP members from parts that tasks have deflated.

A part is a run of raw deflate blocks that ends at a byte boundary (a sync flush), so
parts of a member stand one after the other as they are; their checksums combine
without the text.  Sizes are written in the 64-bit form, behind the data.
"""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO, NamedTuple

_POLYNOMIAL = 0xEDB88320


class Part(NamedTuple):
    """Deflated bytes with the checksum and length of what they hold."""

    data: bytes
    crc: int
    size: int


def deflated(text: bytes, last: bool = False) -> Part:
    """A part; the last one of a member closes its stream."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return Part(packer.compress(text) + packer.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH), zlib.crc32(text), len(text))


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the checksum's, lowest power in the highest bit."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def combined(first: int, second: int, size: int) -> int:
    """The checksum of two runs of bytes from theirs, the second of so many bytes: the first one times x to the 8 * size."""
    power, square, left = 1 << 31, 1 << 30, 8 * size  # 1 and x
    while left:
        if left & 1:
            power = _times(power, square)
        square, left = _times(square, square), left >> 1
    return _times(power, first) ^ second


class Archive:
    """Writes members one after the other to a stream."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts) -> None:
        """A member of parts, the last of which closes its stream."""
        start, crc, packed, size = self.at, 0, 0, 0
        raw = name.encode()
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 8, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        for part in parts:
            self._write(part.data)
            crc, packed, size = combined(crc, part.crc, part.size), packed + len(part.data), size + part.size
        self._write(struct.pack("<4sIQQ", b"PK\7\x08", crc, packed, size))
        self.members.append((raw, start, crc, packed, size))

    def close(self) -> None:
        """Write the central directory, in its 64-bit form."""
        start = self.at
        for raw, place, crc, packed, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, place)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        end, n = self.at, len(self.members)
        self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - start, start))
        self._write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(end - start, 0xFFFFFFFF), 0xFFFFFFFF, 0))
