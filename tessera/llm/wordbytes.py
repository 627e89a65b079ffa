"""Words of whole texts as bytes: A-Z is lower-cased; words are runs of digits, letters a-z and whatever is not ASCII.

As every byte of a character beyond ASCII is above 0x7F, the words of a text and those of its UTF-8 bytes are the same.
"""

from __future__ import annotations

import numpy as np


def _table() -> bytes:
    """For each byte its lower-cased form, or a space where it belongs to no word."""
    out = bytearray(b" " * 256)
    for c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        out[c] = c
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    return bytes(out)


FOLD = _table()
_FOLD = np.frombuffer(FOLD, np.uint8)


def words(text: bytes) -> list[bytes]:
    """The words of a text's UTF-8 bytes."""
    return text.translate(FOLD).split()


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, word offsets into letters, words before each text) of many texts laid end to end.

    letters has the bytes of all words without what parts them; a word never runs from one text into the next.
    """
    low = _FOLD[raw]
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    before = np.r_[0, np.cumsum(inside)]
    return low[inside], np.r_[before[starts], before[-1]], np.searchsorted(starts, offsets)
