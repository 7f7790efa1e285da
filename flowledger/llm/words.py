"""Words of a text as the near-duplicate operators see them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Code points that are hashed at once.
PIECE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplication loses nothing


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit. Fixed constants of splitmix64."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """For every code point whether it belongs to a word: letters, digits and the underscore of any script."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    out = []
    for base in (int(_MULTIPLIER), pow(int(_MULTIPLIER), -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class WordHashes:
    """64-bit hashes of the lower-cased words of a text, the same in every process.

    A word's hash is a polynomial in its code points. Sums over all prefixes of a text give those of all its
    words at once: the difference at a word's ends, divided by the power of its start.
    """

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words, in order."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = _is_word()[code]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(code) <= PIECE:
            return self._hashes(code, starts, ends)
        out, i = [], 0
        while i < len(starts):  # pieces of whole words
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
            out.append(self._hashes(code[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo))
            i = j
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    @staticmethod
    def _hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = _powers(PIECE) if len(code) <= PIECE else _powers(len(code))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * power[: len(code)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash per run of ``size`` words; a shorter text is one run of all its words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = (out + words[i : n - size + 1 + i]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return mix(out)
