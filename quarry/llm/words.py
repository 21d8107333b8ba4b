"""Words and word windows of texts as 64-bit hashes, in numpy.

A word is a run of bytes other than the blank and the controls 9 to 13. Bytes are mapped to
fixed random numbers and summed with powers of a fixed odd number, so that one running sum
gives the hash of every word. Texts of any length are taken in slices that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at once.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers: splitmix64 from a seed."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(step + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))


_BYTE = numbers(11, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = numbers(12, 64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... as 64-bit numbers; kept for lengths up to twice a slice."""
    known = _powers.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    size = n if n > 2 * SLICE else max(1 << 14, 1 << (n - 1).bit_length())
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    if size <= 2 * SLICE:
        _powers[base] = made
    return made[:n]


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SLICE:
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the bytes, in order."""
    found = []
    for part in _slices(data):
        raw = np.frombuffer(part, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        n = len(raw)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_BASE, n), out=run[1:])
        hashed = (run[ends] - run[starts]) * _power(_INVERSE, n)[starts]
        found.append(mixed(hashed + (ends - starts).astype(np.uint64)))
    if not found:
        return np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else np.concatenate(found)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of ``k`` words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _WINDOW[0]
    for j in range(1, k):
        out += words[j : j + n] * _WINDOW[j]
    return mixed(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``k`` words; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    if len(words) < k:
        return windows(np.append(words, np.uint64(k)), len(words) + 1)
    return np.unique(windows(words, k))
