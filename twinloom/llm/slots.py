"""A minimal perfect hash over 16-byte digests, in numpy.

Keys are thrown at a bit array somewhat longer than their number; those that fall alone stay, the others go on to the next,
shorter array. A key's slot is the rank of its bit among all bits, so n keys fill the slots 0 to n - 1. The table keeps the
digest of every slot: a look-up is only believed if it finds its own digest there.
"""

from __future__ import annotations

import numpy as np

#: Bits per key left in each array, and how many arrays there may be: distinct digests need about a dozen.
LOOSE = 1.5
MOST_LEVELS = 64


def numbers(digests: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of n digests of 16 bytes."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03) & ((1 << 64) - 1)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Slots:
    def __init__(self, keys: np.ndarray):
        left, self.sizes, held = keys, [], []
        while len(left):
            if len(held) == MOST_LEVELS:
                raise ValueError("a digest comes twice")
            size = max(16, int(LOOSE * len(left)))
            at = (mixed(left, len(held)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            held.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.concatenate(held) if held else np.zeros(0, bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.stored = np.zeros((len(keys), 2), np.uint64)
        slots = self._slots(keys)
        self.stored[slots] = keys
        if (self.stored[slots] != keys).any():
            raise ValueError("two digests share a slot")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that were not there at the start get any slot, or -1."""
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            here = self.bits[at]
            out[open_[here]] = self.ranks[at[here]]
            open_, start = open_[~here], start + size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The verified slot of each key; -1 for keys of other tables."""
        out = self._slots(keys)
        out[out >= 0] = np.where((self.stored[out[out >= 0]] == keys[out >= 0]).all(axis=1), out[out >= 0], -1)
        return out
