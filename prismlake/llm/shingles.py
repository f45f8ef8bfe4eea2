"""Word shingles as sets of 64-bit hashes, computed over a text's bytes with numpy.

Words are maximal runs without space, tab, line feed, vertical tab, form feed and carriage return, after A-Z are
lower-cased. A word's hash is a polynomial over its bytes, a shingle's hash mixes those of its words in order. A text
with fewer words than a shingle takes has its whole word sequence as its one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: An odd base, its inverse modulo 2**64, and the multipliers of a finalizer.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, _INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers, _inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _powers[:n], _inverses[:n]


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A UTF-8 text's bytes, A-Z lower-cased and white space as blanks, and where each word starts and ends."""
    codes = np.frombuffer(data, dtype=np.uint8)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint8(32), codes)
    codes[(codes >= 9) & (codes <= 13)] = 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], codes != 32, [False]]).view(np.int8)))
    return codes, edge[::2], edge[1::2]


def hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _powers_to(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of a UTF-8 text, in order."""
    return hash_words(*split_words(data)) if data else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    take = min(words, len(h))
    out = np.full(len(h) - take + 1, np.uint64(take))
    for k in range(take):
        out = mix(out * _BASE + h[k : len(h) - take + 1 + k])
    return np.unique(out)
