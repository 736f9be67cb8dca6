"""Hashes of the substrings of a text, computed for many texts at once in numpy."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

WIDTH = 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a Unicode letter or decimal digit."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" or unicodedata.category(chr(i)) == "Nd" for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str) -> np.ndarray:
    """The code points of the lower-cased text that are letters or digits."""
    codes = code_points(text.lower())
    return codes[letter_table().take(codes)]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is several times faster here than a hash table."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def window_hashes(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit hash of each substring of `width` characters; empty if the text is shorter."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    base, out, done = _B, None, 0
    with np.errstate(over="ignore"):
        rest = width
        while rest:  # sums over runs of 1, 2, 4, ... characters, put together by the bits of width
            if rest & 1:
                out = power[done : done + n].copy() if out is None else out * base + power[done : done + n]
                done += size
            rest >>= 1
            if rest:
                power = power[:-size] * base + power[size:]
                base, size = base * base, size * 2
    return mix(out)


def text_key(codes: np.ndarray) -> int:
    """Signed 64-bit key of a whole sequence of code points."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).view(np.int64))
