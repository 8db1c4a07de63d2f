"""Word and shingle hashes of whole texts, computed over byte arrays."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
# One random 64-bit value per byte, upper case folded to lower; 0 marks white space.
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int, known: dict = {}) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; a worker keeps the longest made so far."""
    have = known.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, (n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        have = known[base] = np.multiply.accumulate(have, dtype=np.uint64)
    return have[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a byte array. A word's hash is a polynomial of its bytes,
    taken as a difference of running sums and shifted back to its own start; A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words; all words as one window if there are fewer, none
    without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(3) + words[k:k + n])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; empty without words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.unique(shingle_hashes(word_hashes(data)[0], size))
