"""Distinct word shingles of a text as 64-bit hashes, and their MinHash samples and odd sketch."""

from __future__ import annotations

import numpy as np

# An odd base with its inverse modulo 2 ** 64, and the constants of splitmix64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + np.uint64((salt * BASE + BASE) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
            self.up, self.down = grow(np.uint64(BASE)), grow(np.uint64(INVERSE))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run.

    Words are separated by ASCII white space, A-Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.flatnonzero(np.concatenate([joined == 32, [True]]))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:]
    up, down = POWERS.get(len(joined) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return np.unique(mix((total[ends] - total[starts]) * down[starts]))


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    return tuple(int(mix(hashes, salt).sum(dtype=np.uint64).view(np.int64)) if len(hashes) else 0 for salt in (1, 2))


class MinHasher:
    """``bands * rows`` MinHash samples, band keys and the odd sketch of the samples."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        self.factor = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.place = mix(np.arange(k, dtype=np.uint64), 3)
        self.band = mix(np.arange(bands, dtype=np.uint64), 4)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            some = (low[None, at: at + 1024] ^ self.flip[:, None]) * self.factor[:, None]
            np.minimum(best, some.min(axis=1), out=best)
        return best

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        key = self.band.copy()
        for column in samples.reshape(self.bands, self.rows).T:
            key = mix(key ^ column.astype(np.uint64))
        return key.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Bit *i* is the parity of the samples that hash to *i*; as signed 64-bit words."""
        at = mix(self.place ^ samples.astype(np.uint64)) % np.uint64(self.bits)
        odd = np.bincount(at.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)
