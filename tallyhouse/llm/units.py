"""The matches of a tokenizer's splitting pattern, found for many texts at once, and a memory of their ids.

Texts of code points below 256 are cut by array operations on one byte per
character. The memory knows each distinct match by its length and a 64-bit hash,
and asks for the ids of new ones only. A table over leading bits of the hash tells
where most known ones are; those that it does not are searched for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Classes of the first 256 code points, and the endings that split off after an apostrophe.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
NUMBERS = "0123456789²³¹¼½¾"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CLASS = np.array([SPACE if chr(i) in SPACES else NUMBER if chr(i) in NUMBERS else LETTER if chr(i).isalpha() else OTHER for i in range(256)], np.uint8)

LONGEST = 64  # longer matches are not remembered
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_LEADING = np.uint64(64 - _TABLE_BITS)


def cut(data: np.ndarray, begins: np.ndarray, join_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all matches in ``data``, the texts that begin at ``begins`` (ascending, none empty) one after another.

    Runs of letters, of numbers and of other signs are matches; an ending after
    an apostrophe that starts a match is one with it. With ``join_space`` a space
    before a run belongs to it and other white space is matched too; without,
    white space is left out and each number is a match of its own.
    """
    n = len(data)
    kind = CLASS[data]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(n + 3, bool)  # of a text
    first[begins] = True
    first[n:] = True
    start |= first[:n]
    quotes = np.flatnonzero(data == 39)
    quotes = quotes[start[quotes] & ~first[quotes + 1]]
    if join_space:
        quotes = quotes[first[quotes] | (data[quotes - 1] != 32)]
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])  # space before a run
        start[last] = True
        start[last[data[last] == 32] + 1] = False
    else:
        start |= kind == NUMBER
    if len(quotes):
        after = np.concatenate([data, np.zeros(3, np.uint8)])
        for ending in ENDINGS:
            hit = quotes[after[quotes + 1] == ord(ending[0])]
            if len(ending) == 2:
                hit = hit[(after[hit + 2] == ord(ending[1])) & ~first[hit + 2]]
            start[hit + 1] = False
            rest = hit + 1 + len(ending)
            start[rest[rest < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if not join_space:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th."""
    back = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, back))


class Memory:
    """Ids of matches. ``learn`` gets distinct matches as bytes and returns their ids, flat, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], join_space: bool, dtype, most: int = 1 << 21):
        self.learn, self.join_space, self.dtype, self.most = learn, join_space, dtype, most
        self.powers = _powers(1)
        self._forget()

    def _forget(self, most: int = 0) -> None:
        room = max(self.most, most)
        self.known = 0  # entries are added behind each other; room that is not used is never touched
        self.hashes, self.offsets, self.sizes = np.empty(room, np.uint64), np.empty(room, np.int64), np.empty(room, np.int32)
        self.pool = np.zeros(0, self.dtype)
        self.table = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.others, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by hash, those whose entry of the table is another's

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each match: differences of running sums, taken back to the match's own first power."""
        if len(data) > len(self.powers[0]):
            self.powers = _powers(len(data))
        ahead, back = self.powers
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * ahead[: len(data)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        out ^= out >> np.uint64(32)
        return out * _MIX

    def _add(self, hashes: np.ndarray, matches: list[bytes]) -> None:
        ids, sizes = self.learn(matches)
        begin, end = self.known, self.known + len(hashes)
        self.hashes[begin:end], self.sizes[begin:end] = hashes, sizes
        self.offsets[begin:end] = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids.astype(self.dtype)])
        self.known = end
        entries = (hashes >> _LEADING).astype(np.int64)
        free = np.flatnonzero(self.table[entries] < 0)
        self.table[entries[free]] = begin + free
        other = np.flatnonzero(self.table[entries] != np.arange(begin, end))
        where = np.searchsorted(self.others, hashes[other])
        self.others = np.insert(self.others, where, hashes[other])
        self.places = np.insert(self.places, where, begin + other)

    def _guess(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash as the table has it, and those for which that is not their place."""
        place = self.table[(hashes >> _LEADING).astype(np.int64)].astype(np.int64)
        return place, np.flatnonzero((place < 0) | (self.hashes[place] != hashes))

    def _search(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash that has none in the table, below 0 if it is not known."""
        where = np.searchsorted(self.others, hashes)
        found = np.append(self.others, np.uint64(0))[where] == hashes
        found &= where < len(self.others)
        return np.where(found, np.append(self.places, -1)[where], -1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (one byte a character), flat, and how many each text has."""
        lengths = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        begins = (np.cumsum(lengths) - lengths)[lengths > 0]
        starts, ends = cut(data, begins, self.join_space)
        sizes = ends - starts
        brief = sizes <= LONGEST
        some, which = starts[brief], sizes[brief]
        hashes = self._hashes(data, some, some + which)
        raw = data.tobytes()
        place, missed = self._guess(hashes)
        if len(missed):
            distinct, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = self._search(distinct)
            new = np.flatnonzero(found < 0)
            if len(new):
                if self.known + len(new) > self.most:  # more than fits: begin again with what this call needs
                    missed = np.arange(len(hashes))
                    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                    found, new = np.empty(len(distinct), np.int64), np.arange(len(distinct))
                    self._forget(len(new))
                found[new] = self.known + np.arange(len(new))
                first = missed[at[new]]
                self._add(distinct[new], [raw[s : s + n] for s, n in zip(some[first].tolist(), which[first].tolist(), strict=True)])
            place[missed] = found[back]
        counts = np.empty(len(starts), np.int64)
        offsets = np.empty(len(starts), np.int64)
        counts[brief], offsets[brief] = self.sizes[place], self.offsets[place]
        pool = self.pool
        if not brief.all():
            long = np.flatnonzero(~brief)
            ids, own = self.learn([raw[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            counts[long], offsets[long] = own, len(pool) + np.cumsum(own) - own
            pool = np.concatenate([pool, ids.astype(self.dtype)])
        done = np.cumsum(counts)
        flat = pool[np.repeat(offsets - (done - counts), counts) + np.arange(done[-1] if len(done) else 0)]
        total = np.concatenate([[0], done])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        per_text = np.diff(total[np.searchsorted(starts, bounds)])
        return flat, per_text
