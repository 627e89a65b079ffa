"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams over all its training
texts. A text's own ranking is compared with each profile by out-of-place distance: the sum, over the
text's n-grams, of how far each is from its place in the profile, an absent one counting as PROFILE
places. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import counts, letters, top
from .textbytes import slices

#: N-grams of a profile, and of a text's ranking.
PROFILE = 400
#: Codes that a training task holds for one language before it hands them on.
HELD = 500_000
#: Texts that are predicted at once; bounds a task's memory.
STEP_ROWS = 256

UNKNOWN = "und"


def profiles(df: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over all rows with a text and a language, in rank order.

    Rows with a null text or language teach nothing. Tasks count n-grams, the sums are taken on the
    cluster, and `size` rows a language reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        weight: dict[str, int] = {}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in parts])
            n = np.concatenate([k for _, k in parts])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            return codes[head], np.add.reduceat(n, head)

        def hand_on(lang: str) -> pa.RecordBatch:
            codes, n = summed(held.pop(lang))
            weight.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

        for x in batches:
            for lang, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                codes, n = counts(letters(text))
                if not len(codes):
                    continue
                held.setdefault(lang, []).append((codes, n))
                weight[lang] = weight.get(lang, 0) + len(codes)
                if weight[lang] > HELD:
                    held[lang] = [summed(held[lang])]
                    weight[lang] = len(held[lang][0][0])
                    if weight[lang] > HELD // 2:
                        yield hand_on(lang)
        for lang in list(held):
            yield hand_on(lang)

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).where("lang is not null and t is not null")
    total = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Ranks within a language in two steps: the first over a few hundred parts of it, then over what they leave.
    part = total.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(256)))
    ahead = [F.desc("n"), F.asc("code")]
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*ahead))).where(F.col("r") <= size)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*ahead))).where(F.col("r") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "r", "code").collect():
        out.setdefault(r.lang, []).append((r.r, r.code))
    return {k: np.array([c for _, c in sorted(v)], np.int64) for k, v in sorted(out.items())}


class Profiles:
    """Profiles as one table, for distances to all of them at once."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.size = size
        self.langs = sorted(ranked)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *ranked.values()]))
        self.places = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.codes, ranked[lang]), k] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 minus the distance as a share of the largest possible one."""
        x = letters(text or "")
        if not len(x) or not self.langs:
            return UNKNOWN, 0.0
        mine = top(*counts(x), self.size)
        at = np.searchsorted(self.codes, mine)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != mine)] = len(self.codes)
        place = self.places[at]
        off = np.where(place < 0, self.size, np.abs(place - np.arange(len(mine))[:, None])).sum(0)
        k = int(off.argmin())
        return self.langs[k], float(1 - off[k] / (self.size * len(mine)))


def with_language(df: DataFrame, text_col: str, ranked: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """All columns of df with lang_pred and score after them.

    Texts that are null or have no letter are `und` with score 0, as is every text if no language was
    learned. Ties go to the language that sorts first. Every character of a text counts. Columns of the
    names lang_pred and score in df are replaced.
    """
    df = df.drop("lang_pred", "score")
    model = df.sparkSession.sparkContext.broadcast(Profiles(ranked, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for x in slices(batches, STEP_ROWS):
            found = [table.predict(t) for t in x.column(text_col).cast(pa.string()).to_pylist()]
            new = [pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*x.columns, *new], names=[*x.schema.names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def of_third(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3
