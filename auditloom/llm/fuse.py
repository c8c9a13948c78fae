"""Static binary fuse filter (three-wise, 8-bit fingerprints) over 64-bit keys, built and probed with numpy.

Layout: consecutive segments of a power-of-two length; a key's three slots lie in
three neighbouring segments.  Construction peels whole layers of slots that hold
one key, then assigns fingerprints from the last layer back.  False positives are
about 1 in 256; a key that was put in is always found.
"""

from __future__ import annotations

import struct

import numpy as np

from .runtime import mix

_HEAD = struct.Struct("<QIII")


def _slots(keys: np.ndarray, seed: int, seg_bits: int, n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + np.uint64(seed))
    start = ((h >> np.uint64(32)) * np.uint64(n_starts)) >> np.uint64(32)
    mask = np.uint64((1 << seg_bits) - 1)
    base = start << np.uint64(seg_bits)
    other = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    slots = np.stack([base + (np.uint64(i) << np.uint64(seg_bits)) + ((other >> np.uint64(20 * i)) & mask) for i in range(3)]).astype(np.int64)
    return slots, (h & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """Serialised filter of the distinct keys given (none gives a filter that holds nothing)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    seg_bits = min(18, max(2, int(np.log(n) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    n_starts = max(1, -(-int(n * factor) // (1 << seg_bits)) - 2)
    seed = 1
    while True:
        slots, prints = _slots(keys, seed, seg_bits, n_starts)
        size = (n_starts + 2) << seg_bits
        degree = np.bincount(slots.ravel(), minlength=size)
        folded = np.zeros(size, dtype=np.int64)
        index = np.arange(n, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(folded, row, index)
        layers = []
        alone = np.flatnonzero(degree == 1)
        peeled = 0
        while len(alone):
            ids, first = np.unique(folded[alone], return_index=True)
            layers.append((ids, alone[first]))
            peeled += len(ids)
            for row in slots[:, ids]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(folded, row, ids)
            touched = np.unique(slots[:, ids])
            alone = touched[degree[touched] == 1]
        if peeled == n:
            break
        seed += 1
        if seed % 8 == 0:
            n_starts += 1 + n_starts // 16
    table = np.zeros(size, dtype=np.uint8)
    for ids, own in reversed(layers):
        a, b, c = slots[:, ids]
        table[own] = 0
        table[own] = prints[ids] ^ table[a] ^ table[b] ^ table[c]
    return _HEAD.pack(seed, seg_bits, n_starts, size) + table.tobytes()


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter."""
    seed, seg_bits, n_starts, size = _HEAD.unpack_from(filter_bytes)
    if size == 0 or len(keys) == 0:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(filter_bytes, dtype=np.uint8, offset=_HEAD.size)
    (a, b, c), prints = _slots(keys.astype(np.uint64), seed, seg_bits, n_starts)
    return (table[a] ^ table[b] ^ table[c]) == prints
