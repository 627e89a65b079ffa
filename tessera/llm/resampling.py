"""Importance resampling towards a target: documents are drawn by hashed n-gram gains and Gumbel noise.

Each task numbers the words of its texts and sorts the texts' suffixes by their first n word numbers. In that
suffix array all places of one n-gram lie side by side: a run whose neighbours share a prefix of its length.
An n-gram is joined and hashed once a run, and its bucket is scattered back to the run's places, from which
bucket counts and documents' sums are taken.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .numbering import numbered
from .textbytes import steps, text_buffer
from .wordbytes import spans

#: Bytes of text whose suffixes are sorted together.
STEP = 4 << 20


def word_numbers(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, words by number) of words laid end to end."""
    if len(at) < 2:
        return np.zeros(0, np.int32), []
    column = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)])
    told = column.dictionary_encode()
    return told.indices.to_numpy(), told.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by their first n words, length of the prefix shared with the place before, at most n).

    room is the number of words from a place to the end of its text; nothing is compared beyond it.
    """
    keys = []
    for j in range(n):
        key = np.full(len(ids), -1, np.int32)
        key[: len(ids) - j] = ids[j:]
        key[room <= j] = -1
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if n == 1 else np.lexsort(keys[::-1])
    shared = np.zeros(len(ids), np.int32)
    same = np.ones(max(len(ids) - 1, 0), bool)
    for key in keys:
        k = key[order]
        same &= (k[1:] == k[:-1]) & (k[1:] >= 0)
        shared[1:] += same
    return order, shared


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words before each text, for each length 1..n the bucket of the n-gram at each word, -1 where none starts)."""
    letters, at, first = spans(raw, offsets)
    ids, by_number = word_numbers(letters, at)
    ends = np.repeat(first[1:], np.diff(first))
    room = ends - np.arange(len(ids))
    order, shared = suffix_array(ids, room, n)
    out = []
    for m in range(1, n + 1):
        fits = np.flatnonzero(room[order] >= m)
        # Places too short for m words share fewer than m with what follows them, so no run spans one.
        heads = shared[fits] < m
        runs = np.cumsum(heads) - 1
        hashed = [zlib.crc32(b" ".join([by_number[i] for i in ids[p : p + m]])) % buckets for p in order[fits[heads]].tolist()]
        bucket = np.full(len(ids), -1, np.int64)
        bucket[order[fits]] = np.asarray(hashed, np.int64)[runs]
        out.append(bucket)
    return first, out


def bucket_counts(df: DataFrame, text_col: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a bucket and task is shuffled, one a bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for x in batches:
            raw, offsets = text_buffer(x.column(0))
            for a, b in steps(offsets, STEP):
                part = raw[offsets[a] : offsets[b]]
                for bucket in feature_buckets(part, offsets[a : b + 1] - offsets[a], n, buckets)[1]:
                    total += np.bincount(bucket[bucket >= 0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket at most, whatever the input
        out[r.bucket] = r.n
    return out


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share of each bucket in the target over that in the raw texts)."""
    n, t_all, s_all = len(target), int(target.sum()), int(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def weighted(df: DataFrame, id_col: str, text_col: str, gains: np.ndarray, n: int) -> DataFrame:
    """(id, n_words, n_features, weight) for each row: the number of its features and the sum of their gains."""
    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.r_[held.value, 0]  # the last is that of bucket -1, no feature
        for x in batches:
            raw, offsets = text_buffer(x.column(1))
            for a, b in steps(offsets, STEP):
                first, found = feature_buckets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, len(gain) - 1)
                weight, many = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for bucket in found:
                    weight += np.diff(np.r_[0, np.cumsum(gain[bucket])][first])
                    many += np.diff(np.r_[0, np.cumsum(bucket >= 0)][first])
                cols = [x.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.array(many), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_features", "weight"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the key's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs; rank counts the drawn ones from 1, null for the others.

    Features are the runs of 1 to n consecutive words, hashed into buckets; a bucket's gain compares its smoothed
    share in the target with that in all of docs, and a document's score is the sum of its features' gains plus
    Gumbel noise, which draws without replacement. Of the documents with least_words words or more, the given
    percentage is drawn by score, ties to the smaller id (null ids, whose key is the empty text, first).
    Null and empty texts have no features and weight 0. Repeated rows all count and may all be drawn. An empty
    target gives all buckets the target's share 1 / buckets; an empty docs gives an empty result. Only the named
    columns are read, so others cannot clash.

    Texts are read twice and never shuffled: once for the buckets' counts, once for the weights. Ranks come from a
    numbering by parts of the stored scores.
    """
    if n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("resampling needs runs of a word or more, a bucket or more, and a percentage")
    gains = bucket_gains(bucket_counts(target, target_text, n, buckets), bucket_counts(docs, text_col, n, buckets))
    rows = stored(weighted(docs, id_col, text_col, gains, n).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranks = numbered(able.withColumn("_down", -F.col("score")), "_down", [F.col("id")], "rank").drop("_down")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    cols = ["id", "n_features", "weight", "score"]
    rest = rows.where(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank"))
    return ranks.select(*cols, rank.alias("rank")).unionAll(rest)
