"""Words of many texts at once, as 64-bit hashes computed by numpy without a Python step for each word.

A text is a byte string. Every byte is either a separator or belongs to a word. A word's hash is a polynomial in its bytes,
modulo 2**64, taken from one running sum over all texts and then mixed. Two different words share a hash with a chance of about
2**-64; equal words always do.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the two hashes of a word.
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Words as runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
PLAIN = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words as runs of ASCII letters and digits and bytes beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
#: Words as runs of ASCII letters and bytes beyond ASCII.
LETTERS = _table(lambda b: b >= 0x80 or chr(b).isalpha())

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_SAME = np.arange(256, dtype=np.uint8)


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """hash, start, end: one entry per word, in order; first: index of each text's first word, and the number of words at the end.

    start and end are offsets in `data`, the texts joined by one space.
    """

    def __init__(self, texts: list[bytes | None], word_bytes: np.ndarray = PLAIN, lower: bool = False):
        self.data = b" ".join([t or b"" for t in texts])
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = word_bytes[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self._raw = (_LOWER if lower else _SAME)[raw]
        self.hash = self._hashes(_BASE)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        at = np.cumsum(lengths + 1) - lengths - 1
        self.first = np.append(np.searchsorted(self.start, at), len(self.start))

    def _hashes(self, base: int) -> np.ndarray:
        up, down = _powers(max(1 << 16, 1 << len(self._raw).bit_length()), base)
        sums = np.zeros(len(self._raw) + 1, np.uint64)
        np.cumsum(self._raw.astype(np.uint64) * up[: len(self._raw)] + up[: len(self._raw)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def second(self) -> np.ndarray:
        """Another hash of each word: two words that share both have a chance of about 2**-128."""
        return self._hashes(_OTHER)

    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def place(self) -> np.ndarray:
        """Position of each word in its text."""
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` entries; run i starts at entry i. Runs may cross texts: callers mask those."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASE) + h[j : j + n]
    return mixed(out)


def chain(texts: list[bytes | None], **how) -> np.ndarray:
    """Hashes of the words of all texts (a shorthand for tests and small tables)."""
    return Words(texts, **how).hash
