"""Words of whole texts as 64-bit hashes, computed over the bytes at once."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(19990731)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random factor for each byte; words are polynomials over them, mixed.
_BYTES = _random.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_LOWER = _BYTES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes; `lower` takes A-Z for a-z."""
    global _powers
    raw = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * longest, _BASE)]), dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (_LOWER if lower else _BYTES)[raw[solid[1:-1] == 1]] * _powers[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts, ends
