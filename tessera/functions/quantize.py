"""Blocks of 32 values as a half-precision scale and signed bytes, and rows addressed by token n-grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 32


def quantized(values: np.ndarray) -> bytes:
    """Blocks of a scale and 32 bytes; the number of values is a multiple of 32."""
    x = np.asarray(values, np.float32).reshape(-1, BLOCK)
    scale = np.abs(x).max(1, keepdims=True) / np.float32(127)
    inverse = np.divide(np.float32(1), scale, out=np.zeros_like(scale), where=scale != 0)
    exact = (x * inverse).astype(np.float64)
    q = np.clip(np.sign(exact) * np.floor(np.abs(exact) + 0.5), -127, 127).astype(np.int8)
    return np.concatenate([scale.astype("<f2").view(np.uint8).reshape(-1, 2), q.view(np.uint8)], 1).tobytes()


def dequantized(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if len(b) % (BLOCK + 2):
        raise ValueError(f"{len(b)} bytes are no whole blocks")
    b = b.reshape(-1, BLOCK + 2)
    scale = np.ascontiguousarray(b[:, :2]).view("<f2").astype(np.float32)
    return (b[:, 2:].view(np.int8).astype(np.float32) * scale).ravel()


@F.pandas_udf(T.BinaryType())
def quantize(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else quantized(np.asarray(v)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def dequantize(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else dequantized(b))


def token_rows(tokens: DataFrame, eos: int, ngram: int, multipliers: Sequence[int], sizes: Sequence[int], offsets: Sequence[int]) -> DataFrame:
    """tokens (seq, pos, token) with rows array<long>: the addressed row of each head, from n-grams of 2 and more.

    The context ends at a sequence's start and at an end token; products wrap at 64 bits, which no
    built-in does without overflow, so they are a pandas function over columns of the context.
    """
    per = len(sizes) // (ngram - 1)
    w = Window.partitionBy("seq").orderBy("pos")
    x = tokens.withColumns({f"c{s}": F.coalesce(F.lag("token", s).over(w), F.lit(eos)) for s in range(1, ngram)})

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def rows(*cols: pd.Series) -> pd.Series:
        ctx = [c.to_numpy(np.int64).copy() for c in cols]
        cut = np.zeros(len(ctx[0]), bool)
        for s in range(1, ngram):
            cut |= (ctx[s] < 0) | (ctx[s] == eos)
            ctx[s][cut] = eos
        u = [c.astype(np.uint64) for c in ctx]
        out = []
        mixed = u[0] * np.uint64(multipliers[0])
        for n in range(2, ngram + 1):
            mixed = mixed ^ (u[n - 1] * np.uint64(multipliers[n - 1]))
            out += [mixed % np.uint64(sizes[h]) + np.uint64(offsets[h]) for h in range((n - 2) * per, (n - 1) * per)]
        return pd.Series(list(np.column_stack(out).astype(np.int64)))

    return x.withColumn("rows", rows("token", *[f"c{s}" for s in range(1, ngram)])).drop(*[f"c{s}" for s in range(1, ngram)])


def overlay(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, collisions) of row edits (row, seq, value): the last edit of a row holds; rows edited more than once collide."""
    plan = edits.groupBy("row").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))
    return plan.select("row", "value"), plan.where("n > 1").select("row", "n")
