"""Search queries: lexical, dense, fused, filtered."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, estimate_tokens_bytes, estimate_tokens_ceiling
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import lexical as L
from ..operators.filters import Filter, TimeRange, filter_expr, merge_and
from ..operators.termindex import TermIndex
from ..session import ensure_checkpoint_dir
from .adapters import CHUNKS, COSINE, bm25_sql, chunks, queries_of, vectors
from .registry import Registry, table

R = Registry()
WORDS = "the thing heonor"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ["score"]})


@R.query(f"with {CHUNKS}, {bm25_sql('hits', WORDS, 200)}, capped as (select h.*, row_number() over (partition by ref_doc_id order by rank) as nth from hits h join chunks using (id)) select id, ref_doc_id, round(score, 6) as score from capped join chunks using (id, ref_doc_id) where nth <= 2 qualify row_number() over (order by rank) <= 20".replace("select h.*,", "select h.*, ref_doc_id,"))
def bm25_topk(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    hits = L.top_k(x, WORDS, 200).join(x.select("id", "ref_doc_id"), "id")
    return _rounded(U.cap_per_document(hits, 2, 20, [F.desc("score"), F.asc("id")]).select("id", "ref_doc_id", "score"))


@R.query("with tok as (select regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from documents) select count(*) as n, round(avg(len(t)), 6) as avg_len from tok")
def bm25_corpus_stats(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(L.corpus_stats(chunks(spark, at)), "avg_len")


@R.query("with p as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents), f as (select doc_id, term, count(*) as tf from p group by all) select term, count(*) as df, cast(sum(tf) as bigint) as tf, max(tf) as most from f group by term")
def term_freq(spark: SparkSession, at: str) -> DataFrame:
    p = L.term_frequencies(chunks(spark, at))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))


_Q0 = "q as (select vec_id as query_id, embedding as v from embeddings where vec_id in ({ids}))"


def _dense_sql(ids: str, k: int, where: str = "true") -> str:
    return f"with {_Q0.format(ids=ids)}, s as (select query_id, vec_id as id, {COSINE.format(a='embedding', b='v')} as score from embeddings, q where {where}), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, rank, id, round(score, 6) as score from r where rank <= {k}"


@R.query(_dense_sql("3", 20))
def dense_topk(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(D.dense(vectors(spark, at), queries_of(spark, at, [3]), 20))


@R.query(_dense_sql("3", 10, "label in (1, 2)"))
def dense_filtered(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(D.dense(vectors(spark, at), queries_of(spark, at, [3]), 10, Filter(sources=("label1", "label2"))))


@R.query(_dense_sql("3", 10, "vec_id % 3 = 0"))
def dense_candidates(spark: SparkSession, at: str) -> DataFrame:
    x = vectors(spark, at)
    return _rounded(D.dense(D.among(x, x.where("id % 3 = 0").select("id")), queries_of(spark, at, [3]), 10))


@R.query(_dense_sql("3, 7, 11, 19, 23", 10))
def multi_query_dense(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(D.dense(vectors(spark, at), queries_of(spark, at, [3, 7, 11, 19, 23]), 10))


_LISTS = f"{bm25_sql('one', 'the thing heonor', 50)}, two as (select id, row_number() over (order by n_chars desc, id) as rank from chunks qualify rank <= 50), lists as (select 'lexical' as list, rank, id from one union all select 'long', rank, id from two)"
_RRF = "fused as (select id, sum(1.0 / (60 + rank)) as score from lists group by id), norm as (select id, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end as score from fused)"


def _lists(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    q = spark.sql(f"select 0 as query_id, '{WORDS}' as query")
    one = L.bm25(x, q, 50).select(F.lit("lexical").alias("list"), "rank", "id")
    size = x.select(F.lit(0).alias("query_id"), "id", F.element_at("metadata", "n_chars").cast("long").alias("score"))
    return one.union(L.ranked(size.orderBy(F.desc("score"), "id").limit(50), 50).select(F.lit("long"), "rank", "id"))


@R.query(f"with {CHUNKS}, {_LISTS}, {_RRF} select id, round(score, 6) as score from fused")
def rrf_fusion(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(U.rrf(_lists(spark, at)))


@R.query(f"with {CHUNKS}, {_LISTS}, {_RRF} select id, round(score, 6) as score from norm")
def minmax_norm(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(U.minmax(U.rrf(_lists(spark, at))))


_BONUS = "cast(case when file_path like 'src1/%' then 0.3 when file_path like 'src1%' then 0.2 when file_path like 'src%' then 0.1 else 0.0 end as double)"
_SCORED = f"scored2 as (select c.*, (n.score + {_BONUS}) * case when superseded_by is not null then 0.9 else 1.0 end as score from norm n join chunks c using (id))"
BONUSES = {"src": 0.1, "src1": 0.2, "src1/": 0.3}


@R.query(f"with {CHUNKS}, {_LISTS}, {_RRF}, {_SCORED}, capped as (select *, row_number() over (partition by ref_doc_id order by round(score, 9) desc, id) as nth from scored2 where source <> 'src2'), top as (select *, row_number() over (order by round(score, 9) desc, id) as rank from capped where nth <= 2) select rank, id, round(score, 6) as score from top where rank <= 20")
def hybrid_fused_capped(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    names = [f"src{i}" for i in range(40) if i != 2]
    got = U.fuse(_lists(spark, at), x, 20, spec=Filter(sources=tuple(names)), bonuses=BONUSES)
    return _rounded(got.select("rank", "id", "score"))


@R.query(f"with {CHUNKS} select id, {_BONUS} as bonus from chunks")
def authority_prior(spark: SparkSession, at: str) -> DataFrame:
    return chunks(spark, at).select("id", U.authority_bonus(F.col("file_path"), BONUSES).alias("bonus"))


@R.query(f"with {CHUNKS} select source, count(*) as n, round(sum(cast(case when superseded_by is not null then 0.9 else 1.0 end as double)), 6) as weight from chunks group by source")
def superseded_penalty(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at).withColumn("p", U.superseded_penalty(F.col("superseded_by").cast("string")))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("weight"))


@R.query(f"with {CHUNKS} select id, ref_doc_id from chunks s where superseded_by is null or not exists (select 1 from chunks o where o.ref_doc_id = s.superseded_by)")
def strict_supersede(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    x = x.withColumns({"ref_doc_id": F.col("ref_doc_id").cast("string"), "superseded_by": F.col("superseded_by").cast("string")})
    return U.drop_superseded(x).select("id", F.col("ref_doc_id").cast("long").alias("ref_doc_id"))


@R.query("with h as (select quality * 2 - 1 + toxic * 0 as feedback, [cast(doc_id as varchar), cast(doc_id % 10 as varchar)] as ids from labels) select doc, cast(sum(feedback) as bigint) as feedback from (select feedback, unnest(ids) as doc from h where feedback <> 0) group by doc")
def feedback_prior(spark: SparkSession, at: str) -> DataFrame:
    x = table(spark, at, "labels")
    h = x.select((F.col("quality") * 2 - 1).cast("long").alias("feedback"), F.array(F.col("doc_id").cast("string"), (F.col("doc_id") % 10).cast("string")).alias("document_ids"))
    return U.feedback_prior(h)


def _events(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events")
    return e.select("event_id", F.col("event_type").alias("source"), F.create_map(F.lit("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"))


@R.query("select event_id from events where user_id = 7")
def filter_metadata(spark: SparkSession, at: str) -> DataFrame:
    return _events(spark, at).where(filter_expr(Filter(equal={"user": "7", "absent": ""}))).select("event_id")


@R.query("select event_id from events where event_type in ('view', 'click') and user_id in (1, 2, 3)")
def filter_in(spark: SparkSession, at: str) -> DataFrame:
    return _events(spark, at).where(filter_expr(Filter(sources=("view", "click"), within={"user": ("1", "2", "3")}))).select("event_id")


@R.query("select event_id from events where date_trunc('second', ts) between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-07 12:00:00'")
def filter_time(spark: SparkSession, at: str) -> DataFrame:
    return _events(spark, at).where(filter_expr(Filter(time=TimeRange("ts", datetime(2024, 1, 5), datetime(2024, 1, 7, 12))))).select("event_id")


@R.query("select event_id from events where value >= 10 and value < 50")
def filter_numeric(spark: SparkSession, at: str) -> DataFrame:
    return _events(spark, at).where(filter_expr(Filter(numeric=(("value", ">=", 10.0), ("value", "<", 50.0))))).select("event_id")


@R.query("select event_id from events where event_type = 'click' and user_id in (2, 3) and value > 20 and date_trunc('second', ts) between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-20 00:00:00'")
def filter_merge(spark: SparkSession, at: str) -> DataFrame:
    a = Filter(sources=("view", "click"), within={"user": ("1", "2", "3")}, time=TimeRange("ts", datetime(2024, 1, 1), datetime(2024, 1, 20)))
    b = Filter(sources=("click", "error"), within={"user": ("2", "3", "4")}, time=TimeRange("ts", datetime(2024, 1, 3), None), numeric=(("value", ">", 20.0),))
    return _events(spark, at).where(filter_expr(merge_and(a, b))).select("event_id")


@R.query(f"with {CHUNKS}, {bm25_sql('hits', WORDS, 40)} select h.id, round(h.score, 6) as score from hits h join chunks using (id) where lang = 'en' and n_chars > 2000")
def lexical_limit_then_filter(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    hits = L.top_k(x, WORDS, 40).join(x.select("id", "source", "metadata"), "id")
    return _rounded(hits.where(filter_expr(Filter(equal={"lang": "en"}, numeric=(("n_chars", ">", 2000.0),)))).select("id", "score"))


@R.query("select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as quarter, greatest(1, strlen(text) // 4) as bytes, case when trim(text) = '' then 0 else (length(text) + 3) // 4 end as ceiling from documents")
def token_estimates(spark: SparkSession, at: str) -> DataFrame:
    t = F.col("text")
    return table(spark, at, "documents").select("doc_id", estimate_tokens(t).alias("quarter"), estimate_tokens_bytes(t).alias("bytes"), estimate_tokens_ceiling(t).alias("ceiling"))


@R.query(f"with {CHUNKS}, {bm25_sql('hits', WORDS, 10)}, w as (select h.rank, h.score, c.* from hits h join chunks c using (id)), u as (select sum(greatest(1, strlen(text) // 4)) as used, count(*) as n from w), f as (select ref_doc_id, min(rank) as rank, arg_min(score, rank) as score from w group by ref_doc_id), m as (select c.id, c.ref_doc_id, f.rank, f.score, chunk_index, greatest(1, strlen(text) // 4) as tokens from chunks c join f using (ref_doc_id) where c.id not in (select id from w)), o as (select *, used, n, used + coalesce(sum(tokens) over (order by rank, chunk_index, id rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (order by rank, chunk_index, id) as nth from m, u) select id, ref_doc_id, round(score, 6) as score, 0 as added, rank from w union all select id, ref_doc_id, round(score, 6), 1, nth from o where before < 12000 and n + nth <= 30")
def intra_doc_budget(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at)
    hits = L.bm25(x, spark.sql(f"select 0 as query_id, '{WORDS}' as query"), 10).drop("query_id")
    return _rounded(U.expand_documents(hits.join(x, "id"), x, 12000, 30))


@R.query()
def kept_index_topk(spark: SparkSession, at: str) -> DataFrame:
    """The best chunks by an index of two batches: all texts, then every fourth with the question's words added and every fifth less one gone.

    It writes the index into a folder of its own, so it has no SQL.
    """
    docs = table(spark, at, "documents").select(F.col("doc_id").alias("id"), "text")
    index = TermIndex(spark, f"{ensure_checkpoint_dir(spark)}/term-index-{uuid.uuid4().hex}")
    index.add(0, docs)
    index.add(1, docs.where("id % 4 = 0").withColumn("text", F.concat("text", F.lit(f" {WORDS}"))), docs.where("id % 5 = 1"))
    found = index.search(spark.createDataFrame([(0, WORDS)], "query_id int, query string"), 20)
    return _rounded(found.select("rank", "id", "score"))
