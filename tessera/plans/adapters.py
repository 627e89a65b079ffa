"""The test tables in the shapes of the engine's tables, in DataFrames and in the same words of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def chunks(spark: SparkSession, at: str) -> DataFrame:
    """documents as chunks: five neighbouring rows are the chunks of one document; every seventh is superseded by the next document."""
    d = table(spark, at, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).cast("long").alias("ref_doc_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_index"), "text", "source",
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"),
        F.when(F.col("doc_id") % 7 == 0, F.floor(F.col("doc_id") / 5).cast("long") + 1).alias("superseded_by"),
        F.lit(None).cast("timestamp").alias("valid_to"),
    )


CHUNKS = """chunks as (
  select doc_id as id, doc_id // 5 as ref_doc_id, doc_id % 5 as chunk_index, text, source, lang, n_chars, source || '/' || doc_id || '.md' as file_path,
    case when doc_id % 7 = 0 then doc_id // 5 + 1 end as superseded_by
  from documents
)"""


def bm25_sql(name: str, query: str, k: int, ctes: str = "") -> str:
    """CTEs that leave `name` (id, score, rank): the k best chunks for a query of distinct lower-case words."""
    words = ", ".join(f"'{w}'" for w in query.split())
    return f"""{ctes}tok as (
  select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as t from chunks
), stats as (
  select count(*) as n, avg(len(t)) as avg_len from tok
), post as (
  select id, len, term, count(*) as tf from (select id, len(t) as len, unnest(t) as term from tok) where term in ({words}) group by all
), dfs as (
  select term, count(*) as df from post group by term
), scored as (
  select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as score from post join dfs using (term), stats group by id
), {name} as (
  select id, score, row_number() over (order by round(score, 9) desc, id) as rank from scored qualify rank <= {k}
)"""


def vectors(spark: SparkSession, at: str) -> DataFrame:
    """embeddings as chunks: the label is the source."""
    e = table(spark, at, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("source"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


def queries_of(spark: SparkSession, at: str, ids: list[int]) -> DataFrame:
    """Some stored vectors as queries."""
    e = table(spark, at, "embeddings")
    return e.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


COSINE = "list_inner_product({a}::double[], {b}::double[]) / (sqrt(list_inner_product({a}::double[], {a}::double[])) * sqrt(list_inner_product({b}::double[], {b}::double[])))"
