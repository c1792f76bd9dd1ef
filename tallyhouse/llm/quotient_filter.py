"""A counting quotient filter as sorted arrays, one block of fingerprints at a time.

A 64-bit fingerprint is cut into block, quotient and remainder. Within a block
the filter holds, per quotient, a run of sorted remainders and a counter for each
remainder. Sorted runs make a merge of two filters a merge of their runs, and as
remainders are kept whole, no count is lost or added by it.
"""

from __future__ import annotations

import numpy as np

QUOTIENT_BITS = 6


def blocks(fingerprints: np.ndarray, block_bits: int):
    """(block, filter) for every block that holds any of these fingerprints (uint64, repeats allowed)."""
    entries, counts = np.unique(fingerprints, return_counts=True)
    block = entries >> np.uint64(64 - block_bits)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for own, n in zip(np.split(entries, cuts), np.split(counts, cuts), strict=True):
        if len(own):
            yield int(own[0] >> np.uint64(64 - block_bits)), _pack(own, n, block_bits)


def _pack(entries: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    rest = np.uint64(64 - block_bits - QUOTIENT_BITS)
    quotient = (entries >> rest) & np.uint64((1 << QUOTIENT_BITS) - 1)
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << QUOTIENT_BITS)
    remainders = entries & ((np.uint64(1) << rest) - np.uint64(1))
    return runs.astype("<u4").tobytes() + remainders.astype("<u8").tobytes() + counts.astype("<u8").tobytes()


def entries(block: int, packed: bytes, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, sorted, and their counts."""
    size = 1 << QUOTIENT_BITS
    runs = np.frombuffer(packed, "<u4", size)
    n = int(runs.sum())
    remainders = np.frombuffer(packed, "<u8", n, 4 * size)
    counts = np.frombuffer(packed, "<u8", n, 4 * size + 8 * n)
    rest = 64 - block_bits - QUOTIENT_BITS
    quotient = np.repeat(np.arange(size, dtype=np.uint64), runs)
    head = np.uint64(block << (64 - block_bits)) | (quotient << np.uint64(rest))
    return head | remainders, counts


def merged(block: int, filters: list[bytes], block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and summed counts of several filters of one block."""
    parts = [entries(block, x, block_bits) for x in filters]
    fingerprints = np.concatenate([x for x, _ in parts])
    counts = np.concatenate([x for _, x in parts]).astype(np.int64)
    order = np.argsort(fingerprints, kind="stable")  # runs are sorted already, so this merges them
    fingerprints = fingerprints[order]
    starts = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
    return fingerprints[starts], np.add.reduceat(counts[order], starts)
