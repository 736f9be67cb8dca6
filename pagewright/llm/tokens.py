"""Words of many texts at once as numpy arrays: no loop over characters or words in Python."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from pagewright.llm.shingles import code_points, mix

#: Kinds of characters.
SPACE, LETTER, DIGIT, WIDE, MARK, NEWLINE = range(6)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point. WIDE are letters of scripts without blanks between words; each is a word of its own."""
    out = np.full(0x110000, MARK, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c[0] == "L" or c[0] == "M":
            wide = 0x0E00 <= i < 0x0F00 or 0x3040 <= i < 0xA000 or 0xAC00 <= i < 0xD7B0 or 0xF900 <= i < 0xFB00 or i >= 0x20000
            out[i] = WIDE if wide else LETTER
        elif c[0] == "N":
            out[i] = DIGIT
        elif c[0] == "Z" or c == "Cc":
            out[i] = SPACE
    out[10] = NEWLINE
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        base = np.full(n, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each ended by a line break, and the number of each text's first one."""
    parts = [code_points(t.lower() + "\n") for t in texts]
    lengths = np.array([len(p) for p in parts], int)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum(lengths)])[: len(parts)]


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, kind) of each word: a run of letters, a run of digits (all with one hash), one wide letter, one mark."""
    kind = kinds()[codes]
    start = np.empty(len(codes), bool)
    start[:1] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == WIDE) | (kind[1:] == MARK)
    start &= (kind != SPACE) & (kind != NEWLINE)
    begins = np.flatnonzero(start)
    if not len(begins):
        empty = np.empty(0, int)
        return empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint8)
    same = np.concatenate([start[1:] | (kind[1:] != kind[:-1]), [True]])
    ends_all = np.flatnonzero(same) + 1
    ends = ends_all[np.searchsorted(ends_all, begins, "right")]
    size = 1 << max(16, int(len(codes) + 1).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)])
        hashes = mix((total[ends] - total[begins]) * inverse[begins])
    kinds_of = kind[begins]
    hashes[kinds_of == DIGIT] = np.uint64(7)
    return begins, ends, hashes, kinds_of
