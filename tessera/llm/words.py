"""Vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads differences over all of them."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_PLACES = [np.zeros(0, np.uint64)]


def places(n: int) -> np.ndarray:
    """A random weight for each of the first n bytes of a word.  Powers of one number would let words of alternating
    letters cancel out modulo 2**64, whatever the number; unrelated weights leave nothing to cancel."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(mix(np.arange(1 << max(6, (n - 1).bit_length()), dtype=np.uint64) * _MULT + np.uint64(0x2545F4914F6CDD1D)))
    return _PLACES[0][:n]


def run_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each maximal run of bytes that are inside."""
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    done = np.cumsum(size)
    at = np.arange(done[-1])
    own = at - np.repeat(done - size, size)  # place in the run
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(_VALUES[raw[inside]] * places(int(size.max()))[own], out=total[1:])
    return mix(total[done] - total[done - size] + size.astype(np.uint64)), start, end


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return run_hashes(_LOWER[raw], ~_SPACE[raw])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out *= _MULT
        out += words[j : len(words) - k + 1 + j]
    return mix(out + np.uint64(k))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(window_hashes(word_hashes(text)[0], k)) if text else np.zeros(0, np.uint64)
