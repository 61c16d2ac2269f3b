"""Vectorised work on text bytes: polynomial names of substrings, and splitting into words."""

from __future__ import annotations

import numpy as np

#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_ROOT = np.random.default_rng(20240229)
#: Two independent random values for each byte.
BYTE_NAMES = _ROOT.integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _table(which: str, n: int) -> np.ndarray:
    """BASE**i (or its inverse's powers) modulo 2**64 for i < n at least."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = BASE if which == "up" else pow(BASE, -1, 2**64)
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return have


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Prefixes:
    """Names of arbitrary substrings of one buffer in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0, names: np.ndarray | None = None):
        n = len(data)
        table = BYTE_NAMES[which] if names is None else names
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _table("down", n + 1)[:n], out=self.sums[1:])
        self.up = _table("up", n + 1)

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes wherever they stand; not mixed yet."""
        return (self.sums[end] - self.sums[start]) * self.up[start]


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return mix(a * np.uint64(BASE) + b)


def doubled(h: np.ndarray, have: int) -> np.ndarray:
    """Prefix doubling: names of 2L bytes at all positions, from the names of L bytes there and L bytes on."""
    n = len(h) - have
    return h[:n] * power(have) + h[have:]


#: Byte classes for words: white space, letter, digit, other ASCII that may be cut off, apostrophe, guarded, not ASCII.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, GUARDED, WIDE = range(7)
CLASS = np.full(256, GUARDED, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
for _a, _b, _c in ((65, 91, LETTER), (97, 123, LETTER), (48, 58, DIGIT), (33, 48, MARK), (58, 65, MARK), (91, 97, MARK), (123, 127, MARK), (128, 256, WIDE)):
    CLASS[_a:_b] = _c
CLASS[39] = APOSTROPHE
CLASS[[60, 62, 124]] = GUARDED  # special tokens are written <|name|>
#: Where a piece may start, by the class before and the class here.
_CUT = np.zeros((7, 7), bool)
_CUT[SPACE, LETTER:] = True
for _a, _b in ((LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, DIGIT), (LETTER, MARK), (DIGIT, MARK), (LETTER, APOSTROPHE), (DIGIT, APOSTROPHE), (MARK, LETTER), (MARK, DIGIT)):
    _CUT[_a, _b] = True
_CUT = _CUT.ravel()
#: Byte names that read A-Z as a-z.
FOLDED = BYTE_NAMES[0].copy()
FOLDED[65:91] = FOLDED[97:123]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes between which a tokenizer that drops white space, takes letters,
    single digits and other marks apart and knows English contractions always cuts. Rows are kept apart."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cls = CLASS[data]
    before = np.empty(n, np.uint8)
    before[0] = SPACE
    before[1:] = cls[:-1]
    first = offsets[:-1]
    before[first[first < n]] = SPACE
    cut = _CUT[before * np.uint8(7) + cls]
    start = np.flatnonzero(cut)
    ends = np.zeros(n + 1, bool)
    ends[:-1] = cut | ((cls == SPACE) & (before != SPACE))
    ends[offsets] = True
    inside = np.zeros(n + 1, bool)
    inside[1:] = cls != SPACE
    return start, np.flatnonzero(ends & inside)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters, digits and bytes beyond ASCII. Rows are kept apart."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cls = CLASS[data]
    word = (cls == LETTER) | (cls == DIGIT) | (cls == WIDE)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:] & before[1:]  # a row's first byte never continues a word
    return start, np.flatnonzero(word & ~after) + 1
