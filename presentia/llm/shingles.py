"""Word hashes and word shingles of many texts at once, on NumPy arrays."""

from __future__ import annotations

import functools

import numpy as np

#: White space is [\x20\x09-\x0D]; letters A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KEEP = bytes(range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random odd number for each byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(whole: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in ``whole``.

    Returns the hashes, where each text's words start in them (one more than texts), and the words'
    byte positions in ``whole`` (from, to).
    """
    n = len(whole)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    buf = np.frombuffer(whole, np.uint8)
    power, inverse = _powers(1 << max(20, n.bit_length()))
    word = ~_BLANK[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return mixed(out)


def shingle_sets(whole: bytes, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    words, at, _, _ = word_hashes(whole, offsets)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mixed(gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
