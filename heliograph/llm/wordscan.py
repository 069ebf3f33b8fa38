"""Vectorised scanning of text batches with NumPy: words, hashes of words and hashes of word windows.

The hash of a range of units is the sum of a mixed value of every (unit, place in the
range), so all ranges of a batch cost the same few array operations whatever their
length.  The mixing is not linear, so texts built of few letters in clever orders don't
collide as they do under polynomials modulo 2**64.  A second sum over the same values
mixed once more is a check that is independent of the first: 128 bits in all.
"""

from __future__ import annotations

import numpy as np

_UNIT, _AT, _MORE, _CHECK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def checked_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(hash, second hash) of units[starts:ends] for each range; equal ranges have equal hashes wherever they stand."""
    lengths = ends - starts
    stops = np.cumsum(lengths)
    place = np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - lengths, lengths)
    x = units[place + np.repeat(starts, lengths)].astype(np.uint64)
    x += np.uint64(1)
    x *= _UNIT
    x += place.astype(np.uint64) * _AT
    x ^= x >> np.uint64(32)
    x *= _MORE
    x ^= x >> np.uint64(29)
    sums = np.zeros(len(x) + 1, np.uint64)

    def total() -> np.ndarray:
        np.cumsum(x, out=sums[1:])
        return mixed(sums[stops] - sums[stops - lengths] + lengths.astype(np.uint64))

    first = total()
    if not check:
        return first, None
    x *= _CHECK
    x ^= x >> np.uint64(31)
    return first, total()


def range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first of ``checked_hashes``."""
    return checked_hashes(units, starts, ends, check=False)[0]


_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, starts, ends) of the runs of ASCII digits, ASCII letters and non-ASCII characters.

    UTF-8 keeps every byte of a non-ASCII character at 128 or above, so the runs of
    bytes are exactly the runs of characters.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([0], _WORD[raw].view(np.int8), [0])))
    return _LOW[raw], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Odd multipliers that mark a word's place in a window.
_PLACE = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; entry i covers words i .. i+n-1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _PLACE[k % 64] + np.uint64(k // 64)
    return mixed(out)


def chunks(sizes: list[int], most: int):
    """Slices of a batch whose sizes sum to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
