"""Streams of rows in blocks: first what a block holds, then what is asked of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def meet(held: DataFrame, asked: DataFrame, schema: str, settle: Callable, answer: Callable) -> DataFrame:
    """For each value of column `block`: settle(block, rows held), then answer(that, rows asked) batch by batch.

    Both tables have the same columns, `block` first. A task holds the rows held of one block at a time;
    rows asked stream past, so their number is not bounded by memory. answer gives a RecordBatch or None.
    """
    spark = held.sparkSession
    cols = held.columns
    rows = held.selectExpr("block", "0 as part", *cols[1:]).union(asked.selectExpr("block", "1 as part", *cols[1:]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, state = None, [], None
        for x in batches:
            b, p = x.column(0).to_numpy(), x.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                part = x.slice(lo, hi - lo)
                if int(b[lo]) != block:
                    block, kept, state = int(b[lo]), [], None
                if p[lo] == 0:
                    kept.append(part)
                    continue
                if state is None:
                    state = (settle(block, pa.Table.from_batches(kept).combine_chunks()) if kept else None,)
                    kept = []
                if state[0] is not None and (out := answer(state[0], part)) is not None:
                    yield out

    return rows.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(run, schema)
