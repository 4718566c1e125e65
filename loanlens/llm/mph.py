"""Minimal perfect hashing of 64-bit keys (cascade of bit arrays), vectorised.

Level k has ``GAMMA`` bits per key that is still unplaced; a key stays on the first level where no other
key takes its bit. The key's number is the rank of its bit over all levels. Keys outside the set
get some number too, so users keep a fingerprint per number.
"""

from __future__ import annotations

import numpy as np

from .textbytes import _mix

GAMMA = 2.0
_LEVELS = 64


def _slot(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    salted = _mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))
    return (salted % np.uint64(n_bits)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes in bits and the packed bits of all levels, for distinct uint64 keys."""
    sizes, parts, left = [], [], keys
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys are not distinct")
        n_bits = max(8, int(len(left) * GAMMA) + 7 & ~7)
        at = _slot(left, len(sizes), n_bits)
        alone = np.bincount(at, minlength=n_bits) == 1
        sizes.append(n_bits)
        parts.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(parts) if parts else np.zeros(0, bool)
    return np.array(sizes, dtype=np.int64), np.packbits(bits)


class Lookup:
    def __init__(self, sizes: np.ndarray, packed: np.ndarray):
        self.sizes = sizes
        self.bits = np.unpackbits(packed)[:int(sizes.sum())].astype(bool)
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where no level holds its bit (then it is not in the set)."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, n_bits in enumerate(self.sizes.tolist()):
            at = base + _slot(keys[left], level, n_bits)
            here = self.bits[at]
            out[left[here]] = self.before[at[here]]
            left, base = left[~here], base + n_bits
        return out
