"""Byte-pair merges by rank over the characters of a word."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(word: str, ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """The word's pieces after all merges, the lowest rank first, the leftmost of equal pairs first."""
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), len(ranks)), i))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def merges(word: Column, ranks: Mapping[tuple[str, str], int]) -> Column:
    """The pieces of each word; a distinct word of a batch is merged once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(words: pd.Series) -> pd.Series:
        known = {w: merged(w, ranks) for w in words.dropna().unique()}
        return words.map(known).astype(object).where(words.notna(), None)

    return run(word)
