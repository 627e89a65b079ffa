"""Dense retrieval: filtered cosine top-k, several queries at once, and restriction to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .filters import Filter, filter_expr
from .lexical import ranked


def dense(chunks: DataFrame, queries: DataFrame, k: int, spec: Filter | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest chunks of each query by cosine, ties by id.

    chunks: id, embedding (and source, metadata for a filter, which applies before scoring). queries:
    query_id, vector - the sub-questions of one question, few by their nature. Every task keeps k rows a
    query before anything is shuffled.
    """
    x = chunks.where(F.col("embedding").isNotNull())
    if spec is not None:
        x = x.where(filter_expr(spec))
    met = x.select("id", "embedding").crossJoin(queries.select("query_id", "vector"))
    return ranked(met.select("query_id", "id", cosine(F.col("embedding"), F.col("vector")).alias("score")), k)


def one_query(chunks: DataFrame, vector: list[float], k: int, spec: Filter | None = None) -> DataFrame:
    """(id, score) of the k nearest chunks of one vector: a bounded heap a task."""
    x = chunks.where(F.col("embedding").isNotNull())
    if spec is not None:
        x = x.where(filter_expr(spec))
    q = F.array(*[F.lit(float(v)) for v in vector])
    return x.select("id", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)


def among(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The chunks whose id is a candidate's."""
    return chunks.join(candidates.select("id"), "id", "left_semi")


def candidate_cap(k: int) -> int:
    return max(64, 4 * k)


def dense_prefiltered(chunks: DataFrame, lexical_hits: DataFrame, linked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dense top-k over candidates of other legs, lexical hits first, capped; over everything if they are none."""
    both = lexical_hits.select("id", F.lit(0).alias("leg"), "rank").union(linked.select("id", F.lit(1).alias("leg"), "rank"))
    first = both.groupBy("id").agg(F.min(F.struct("leg", "rank")).alias("at")).orderBy("at", "id").limit(candidate_cap(k))
    return dense(chunks if first.isEmpty() else among(chunks, first), queries, k)
