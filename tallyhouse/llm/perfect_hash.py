"""Minimal perfect hashing of 64-bit keys: n distinct keys get the numbers 0 to n - 1, in about three bits a key.

Level after level, the keys still without a number fall on twice as many bits as
there are of them; those that fall on a bit alone set it and are numbered by the
set bits up to theirs. A key that was not there when the function was built gets
some number or none, so whoever looks up compares with the key kept under it.
"""

from __future__ import annotations

import numpy as np

LEVELS = 40  # after so many, keys that never fell alone are kept as they are; hardly ever any
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift in (32, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * _MIX
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """The function of some distinct keys (unsigned 64-bit)."""
    sizes, levels = [], []
    while len(keys) and len(levels) < LEVELS:
        size = 2 * len(keys)
        place = _places(keys, len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone).tobytes())
        keys = keys[~alone[place]]
    head = np.array([len(sizes), *sizes], "<i8").tobytes()
    return b"".join([head, *levels, np.sort(keys).astype("<u8").tobytes()])


def numbers(function: bytes, keys: np.ndarray) -> np.ndarray:
    """The number of each key, -1 where a strange key has none."""
    count = int(np.frombuffer(function, "<i8", 1)[0])
    sizes = np.frombuffer(function, "<i8", count, 8).tolist()
    at, ahead = 8 * (count + 1), 0
    out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, size in enumerate(sizes):
        packed = np.frombuffer(function, np.uint8, -(-size // 8), at)
        at += len(packed)
        bits = np.unpackbits(packed, count=size).astype(bool)
        place = _places(keys[open_], level, size)
        hit = bits[place]
        rank = np.cumsum(bits)
        out[open_[hit]] = ahead + rank[place[hit]] - 1
        ahead += int(rank[-1])
        open_ = open_[~hit]
    rest = np.frombuffer(function, "<u8", offset=at)
    if len(rest):
        place = np.minimum(np.searchsorted(rest, keys[open_]), len(rest) - 1)
        out[open_] = np.where(rest[place] == keys[open_], ahead + place, -1)
    return out


def verified(function: bytes, kept: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key, -1 for keys that ``kept``, the keys by their numbers, does not hold."""
    if not len(kept):
        return np.full(len(keys), -1, np.int64)
    at = numbers(function, keys)
    return np.where(kept[at] == keys, at, -1)
