"""A minimal perfect hash over a fixed set of keys, and the packed table beside it.

Level by level, each key that is left takes a place in a bit array; places that just one
key takes are kept, the other keys go on to the next level. The number of kept places
before a key's own is its slot, so n keys have the slots 0 to n - 1. A stored fingerprint
tells keys of the set from others.
"""

from __future__ import annotations

import struct

import numpy as np

#: Places for each key left on a level: more makes fewer levels and a larger index.
SPREAD = 2.0
_HEAD = struct.Struct("<II")


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place in a level from a key's two hashes."""
    x = a + b * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(33))) % np.uint64(size)


def build(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The index of keys with hashes (a, b), all different, and the slot of each key."""
    left = np.arange(len(a))
    levels, slots, taken = [], np.zeros(len(a), np.int64), 0
    while len(left):
        size = max(64, int(SPREAD * len(left)))
        size += -size % 64
        places = _places(a[left], b[left], len(levels), size)
        alone = np.bincount(places.astype(np.int64), minlength=size) == 1
        rank = np.cumsum(alone) - 1
        kept = alone[places]
        slots[left[kept]] = taken + rank[places[kept]]
        taken += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~kept]
        if len(levels) > 200:
            raise ValueError("two keys have the same hashes")
    head = _HEAD.pack(len(a), len(levels))
    return head + b"".join(struct.pack("<I", len(x)) for x in levels) + b"".join(levels), slots


def slots_of(index: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has its place, so it is surely no key."""
    _, count = _HEAD.unpack_from(index)
    sizes = struct.unpack_from(f"<{count}I", index, _HEAD.size)
    at, taken = _HEAD.size + 4 * count, 0
    slots = np.full(len(a), -1, np.int64)
    left = np.arange(len(a))
    for level, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(index, np.uint8, size, at), bitorder="little")
        places = _places(a[left], b[left], level, size * 8)
        hit = bits[places].astype(bool)
        slots[left[hit]] = taken + (np.cumsum(bits, dtype=np.int64) - 1)[places[hit]]
        taken += int(bits.sum())
        at += size
        left = left[~hit]
    return slots
