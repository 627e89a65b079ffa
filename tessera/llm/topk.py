"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are rows of integer weights; a term is a dimension, and its postings in a block of candidates
are that dimension's weights. For each query and each of its non-zero terms, the weighted postings are
added into a dense array of scores over the block; partition selection then leaves k of each array,
and the few that every block leaves are merged for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix, meet

#: Wanted candidates of a block.
BLOCK_ROWS = 8192


def usable(vector: Column) -> Column:
    """Whether a vector is present and has no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, best first, ties by smaller id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def accumulate(query: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Dense scores of a block for one query: its non-zero terms scatter their weighted postings, one after another."""
    scores = np.zeros(postings.shape[1], np.int64)
    for term in np.flatnonzero(query):
        scores += query[term] * postings[term]
    return scores


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best candidates by integer inner product.

    Vectors are arrays of whole numbers of 64 bits, sums that overflow wrap. Rows whose vector or id is
    null, or whose vector holds a null, take no part. A candidate with the query's id is the query's own
    and is left out; one of another width is no candidate. Of several queries of one id the one with the
    smallest vector is asked; repeated candidate rows count each. Ties go to the smaller id. Fewer
    candidates than k are all returned; no queries or no candidates give an empty result. Only the two
    named columns are read, so others cannot clash.

    Blocks are of one width and dealt by contents; the queries pass every block and leave k rows in each.
    """

    def read(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"))
        return x.where("id is not null and v is not null and not exists(v, x -> x is null)").withColumn("width", F.size("v"))

    c = read(candidates)
    sizes = c.groupBy("width").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    # One row for each width of vectors, numbered from its first block on.
    first = sizes.withColumn("first", F.sum("n").over(Window.orderBy("width").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    held = c.join(first, "width").select((F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("n"))).cast("int").alias("block"), "id", "v")
    q = read(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    asked = q.join(first, "width").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1).cast("array<int>")).alias("block"), "id", "v")

    def settle(_: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows["id"].to_numpy(), np.ascontiguousarray(matrix(rows["v"].combine_chunks(), "i8").T)

    def answer(state: tuple[np.ndarray, np.ndarray], rows: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, postings = state
        out = []
        for who, query in zip(rows.column("id").to_pylist(), matrix(rows.column("v"), "i8"), strict=True):
            others = np.flatnonzero(ids != who)
            best = others[select_top(accumulate(query, postings)[others], ids[others], k)]
            out.append((np.full(len(best), who), ids[best], accumulate(query, postings[:, best])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["query_id", "id", "score"])

    left = meet(held, asked, "query_id long, id long, score long", settle, answer)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
