"""Rank fusion and what follows it: normalisation, priors, supersession, caps, expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens_bytes
from .filters import Filter, filter_expr

RRF_K = 60
PER_DOCUMENT = 2


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) from rank lists (list, rank, id), ranks from 1: the sum of 1 / (k + rank)."""
    return lists.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def minmax(rows: DataFrame, score: str = "score") -> DataFrame:
    """rows with the score rescaled to 0..1 over all of them; all equal gives 1.

    The two bounds are one row, aggregated with partial sums and broadcast.
    """
    bounds = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    x = rows.crossJoin(F.broadcast(bounds))
    return x.withColumn(score, F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def authority_bonus(path: Column, bonuses: dict[str, float]) -> Column:
    """The bonus of the longest prefix of the path; 0 without one."""
    out = F.lit(0.0)
    for prefix in sorted(bonuses, key=lambda p: (len(p), p)):
        out = F.when(path.startswith(prefix), F.lit(float(bonuses[prefix]))).otherwise(out)
    return out


def superseded_penalty(by: Column) -> Column:
    return F.when(F.coalesce(by.cast("string"), F.lit("")) != "", F.lit(0.9)).otherwise(F.lit(1.0))


def feedback_prior(history: DataFrame) -> DataFrame:
    """(doc, feedback): the sum of ratings of each document over rated answers that named it."""
    rated = history.where(F.col("feedback") != 0)
    return rated.select(F.explode("document_ids").alias("doc"), "feedback").groupBy("doc").agg(F.sum("feedback").alias("feedback"))


def drop_superseded(rows: DataFrame) -> DataFrame:
    """Rows whose superseding document is not among the rows' documents."""
    docs = rows.select(F.col("ref_doc_id").alias("newer")).distinct()
    return rows.join(docs, F.coalesce(rows.superseded_by, F.lit("")) == docs.newer, "left_anti")


def cap_per_document(rows: DataFrame, cap: int, k: int, order: list[Column]) -> DataFrame:
    """The first `cap` rows of each document in the order, then k in all, with their rank from 1."""
    nth = F.row_number().over(Window.partitionBy("ref_doc_id").orderBy(*order))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth").orderBy(*order).limit(k)
    # k rows at most.
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(
    lists: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    cap: int = PER_DOCUMENT,
    spec: Filter | None = None,
    bonuses: dict[str, float] | None = None,
    feedback: DataFrame | None = None,
    feedback_weight: float = 0.0,
    strict: bool = False,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The answer of several legs: chunks with score and rank.

    All fused ids take part in the normalisation, then the filter drops rows, then priors and the penalty
    for superseded chunks apply, strict mode drops chunks whose successor is there too, and the cap holds
    last. rerank may add a column `position`, which then sets the order; scores stay.
    """
    x = minmax(rrf(lists)).join(chunks, "id")
    if spec is not None:
        x = x.where(filter_expr(spec))
    prior = authority_bonus(F.col("file_path"), bonuses or {})
    if feedback is not None and feedback_weight:
        x = x.join(feedback, x.ref_doc_id == feedback.doc, "left")
        prior = prior + F.lit(feedback_weight) * F.coalesce("feedback", F.lit(0))
    x = x.withColumn("score", (F.col("score") + prior) * superseded_penalty(F.col("superseded_by")))
    if strict:
        x = drop_superseded(x)
    order = [F.desc("score"), F.asc("id")]
    if rerank is not None:
        x = rerank(x)
        order = [F.asc_nulls_last("position"), *order]
    return cap_per_document(x, cap, k, order)


def expand_documents(winners: DataFrame, chunks: DataFrame, budget: int, k: int) -> DataFrame:
    """winners (rank, score, and chunk columns) with further active chunks of their documents.

    Siblings come in the order of winners, then of chunk_index, as long as the tokens before one are
    under the budget and fewer than k rows are there. Only the winners' documents are read.
    """
    have = winners.select("id", "ref_doc_id", "rank", "score", estimate_tokens_bytes(F.col("text")).alias("tokens"))
    used = have.agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    first = have.groupBy("ref_doc_id").agg(F.min(F.struct("rank", "score")).alias("w"))
    more = chunks.where(F.col("valid_to").isNull()).join(have.select("id"), "id", "left_anti").join(first, "ref_doc_id")
    more = more.select("id", "ref_doc_id", F.col("w.rank").alias("rank"), F.col("w.score").alias("score"), "chunk_index", estimate_tokens_bytes(F.col("text")).alias("tokens"))
    # k rows at most take part from here on: each sibling has one token or more.
    more = more.orderBy("rank", "chunk_index", "id").limit(k).crossJoin(F.broadcast(used))
    w = Window.orderBy("rank", "chunk_index", "id")
    more = more.withColumns({"before": F.col("used") + F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "nth": F.row_number().over(w)})
    more = more.where((F.col("before") < budget) & (F.col("n") + F.col("nth") <= k))
    return have.select("id", "ref_doc_id", "score", F.lit(0).alias("added"), "rank").union(more.select("id", "ref_doc_id", "score", F.lit(1).alias("added"), F.col("nth").alias("rank")))
