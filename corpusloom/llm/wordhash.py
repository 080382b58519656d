"""Words of an Arrow text column as 64-bit hashes, without a Python call per row or word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from corpusloom.llm.codepoints import rows_of, unpack
from corpusloom.llm.unicode_form import compose, tables

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point (0 gap, 1 part of a word, 2 dropped inside words) and its lower-case form."""
    top = 0x30000
    kind, low = np.zeros(top, np.uint8), np.arange(top, dtype=np.int64)
    for o in range(top):
        if 0xD800 <= o < 0xE000:
            continue
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat[0] in "LMN":
            kind[o] = 1
            l = ch.lower()
            if len(l) == 1:
                low[o] = ord(l)
        elif cat == "Cf" or ch in "'’‘ʼ`´":
            kind[o] = 2
    return kind, low


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of all words of all rows in order; start counts code points of the row as stored, marks composed."""
    kind, low = _classes()
    _, _, _, ccc, keys, made = tables()
    cps, bounds = unpack(col)
    row = rows_of(bounds)
    cps = np.where(cps < len(low), low[np.minimum(cps, len(low) - 1)], cps)
    cps, row = compose(cps, row, ccc, keys, made)
    k = np.where(cps < len(kind), kind[np.minimum(cps, len(kind) - 1)], 0)
    keep = k != 2
    cps, row, k = cps[keep], row[keep], k[keep]
    word = k == 1
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = word & np.concatenate([[True], ~word[:-1] | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    at = np.flatnonzero(word)
    no = np.cumsum(new)[at] - 1
    place = (at - first[no]).astype(np.uint64)
    # sum over the word of a mix of letter and place: any order of evaluation gives the same hash
    x = (cps[at].astype(np.uint64) + np.uint64(1)) * _MIX + place * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = np.add.reduceat(x, np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]])))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h, row[first], first
