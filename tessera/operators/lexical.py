"""BM25 over chunks: postings, corpus statistics and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import ensure_checkpoint_dir

K1, B = 1.2, 0.75
#: Distinct query terms that are looked for row by row.
QUERY_TERMS = 256


def term_frequencies(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, len): each term of each chunk, with the chunk's token count."""
    x = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    x = x.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return x.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n chunks and their mean token count."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("avg_len"))


def score(tf: Column, length: Column, df: Column, n: Column, average: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k best chunks of each query, ties by id; rank counts from 1.

    queries: query_id, query. A term that a query repeats counts again. Texts are read and tokenised once:
    of each chunk its length and its tokens that some query has are kept, which statistics and postings
    then share. Up to QUERY_TERMS distinct query terms are looked for in the row; more, by a join.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = q.select("term").distinct()
    some = [r.term for r in wanted.limit(QUERY_TERMS + 1).collect()]
    x = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    if len(some) <= QUERY_TERMS:
        asked = F.array(*[F.lit(t) for t in sorted(some)]).cast("array<string>")
        x = x.select("id", F.size("tokens").alias("len"), F.filter("tokens", lambda t: F.array_contains(asked, t)).alias("terms")).checkpoint()
        met = x.select("id", "len", F.explode("terms").alias("term"))
    else:
        x = x.select("id", F.size("tokens").alias("len"), "tokens").checkpoint()
        met = x.select("id", "len", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    stats = x.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = met.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    # One row of statistics.
    scored = postings.join(df, "term").join(q, "term").crossJoin(F.broadcast(stats))
    scored = scored.groupBy("query_id", "id").agg(F.sum(F.col("times") * score(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avg_len"))).alias("score"))
    return ranked(scored, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(chunks: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score): the k best chunks of one query; a bounded heap a task, no shuffle of texts."""
    spark = chunks.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    return bm25(chunks, q, k, id_col, text_col).orderBy("rank").select("id", "score")


def match_expression(query: Column) -> Column:
    """A query as a full-text expression: its tokens quoted and joined by OR, so that no operator gets through."""
    return F.array_join(F.transform(tokens(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def full_text(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score) as a full-text index ranks: the better the match, the lower the score, below 0.

    A query without tokens, or k of 0 or less, finds nothing.
    """
    if k <= 0:
        return chunks.sparkSession.createDataFrame([], "query_id int, rank int, id string, score double")
    return bm25(chunks, queries, k, id_col, text_col).withColumn("score", -F.col("score"))
