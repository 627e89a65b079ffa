"""Character n-grams of whole texts as numpy codes.

Letters are lower-cased; whatever is no letter ends a word. Words stand between marks, so an n-gram
tells a word's beginning and end. A code packs up to three characters of 21 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, its lower-cased letter, or MARK for whatever is no letter."""
    out = np.full(0x110000, MARK, np.int32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """The text's letters with one MARK between words and at both ends; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.empty(len(points) + 2, np.int32)
    x[0] = x[-1] = MARK
    x[1:-1] = _letters()[points]
    keep = np.r_[True, (x[1:] != MARK) | (x[:-1] != MARK)]
    x = x[keep]
    return x if len(x) > 1 else x[:0]


def counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1-, 2- and 3-grams of letters(); a lone mark is none."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    y = x.astype(np.int64)
    two = (y[:-1] << 21) | y[1:]
    three = (two[:-1] << 21) | y[2:]
    one = y[y != MARK]
    codes = np.concatenate([one, two, three])
    codes.sort()
    head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[head], np.diff(np.r_[head, len(codes)])


def top(codes: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The codes of the `most` largest counts, most frequent first, ties by smaller code."""
    if len(codes) > 2 * most:
        bar = np.partition(count, len(count) - most)[len(count) - most]
        keep = count >= bar
        codes, count = codes[keep], count[keep]
    return codes[np.lexsort((codes, -count))[:most]]
