"""The queries of the package's operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import make_importable, spread

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 8


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table; the texts of a small one are dealt to all cores."""
    rows = make_importable(spark).read.parquet(f"{at}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_rendezvous_shards(spark: SparkSession, at: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sharding import shard_rows

    rows = shard_rows(_table(spark, at, "documents"), "doc_id", "text", [1.0] * SHARDS)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_tool_call_linking(spark: SparkSession, at: str) -> DataFrame:
    from .toolcalls import chat_schemas, linked, turns_as_calls

    return linked(*turns_as_calls(_table(spark, at, "conversations")), chat_schemas(spark))


OP2_SQL = """
with recursive asked as (
  select cast(t.conv_id as varchar) as conv_id, cast(t.turn as varchar) as call_id, t.turn as position, t.role, t.text,
    case when t.role = 'user' then t.turn - 2 else l.last end as needs
  from conversations t left join (select conv_id, max(turn) as last from conversations where role = 'user' group by conv_id) l on t.conv_id = l.conv_id
  where t.role in ('user', 'system')
), edges as (
  select distinct a.conv_id, a.position, b.position as needs from asked a join asked b on a.conv_id = b.conv_id and a.needs = b.position and a.position <> b.position
), reach as (
  select conv_id, position, needs from edges
  union
  select r.conv_id, r.position, e.needs from reach r join edges e on r.conv_id = e.conv_id and r.needs = e.position
), places as (
  select a.conv_id, a.position, greatest(a.position, max(r.needs)) as place, coalesce(bool_or(r.needs = a.position), false) as cyclic
  from (select distinct conv_id, position from asked) a left join reach r on a.conv_id = r.conv_id and a.position = r.position group by a.conv_id, a.position
), orders as (
  select p.conv_id, p.position, p.place, p.cyclic, count(distinct o.needs) as depth
  from places p left join (
    select r.conv_id, r.position, r.needs, q.place from reach r join places q on r.conv_id = q.conv_id and r.needs = q.position
  ) o on p.conv_id = o.conv_id and p.position = o.position and p.place = o.place group by all
), results as (
  select cast(conv_id as varchar) as conv_id, cast(turn - 1 as varchar) as call_id, turn as position, text as content from conversations where role = 'assistant'
), firsts as (
  select conv_id, call_id, min_by(position, (position, content)) as position, min_by(content, (position, content)) as content, count(*) as results from results group by all
), joined as (
  select a.conv_id, a.call_id, a.position, a.role, a.text, f.content, f.results, f.position as answered, o.place, o.depth, o.cyclic,
    concat_ws('; ',
      case when a.text is null then 'missing prompt' when length(a.text) < 1 or (a.role = 'user' and length(a.text) > 400) then 'out of range: prompt' end,
      case when a.position < 0 or (a.role = 'system' and a.position > 0) then 'out of range: turn' end) as faults,
    case when f.conv_id is null then 'unanswered' when f.position < a.position then 'early' else 'ok' end as status
  from asked a left join firsts f on a.conv_id = f.conv_id and a.call_id = f.call_id
  join orders o on a.conv_id = o.conv_id and a.position = o.position
)
select conv_id, call_id, position, place as order_after, cast(depth as integer) as order_depth, cyclic, status, coalesce(results, 0) as results, faults = '' as valid, faults,
  '{"arguments":{' || case when text is null then '' else '"prompt":' || cast(to_json(text) as varchar) || ',' end || '"turn":' || call_id || '}'
  || case when content is null then '' else ',"content":' || cast(to_json(content) as varchar) end
  || ',"id":"' || call_id || '","name":"' || case when role = 'user' then 'reply' else 'setup' end || '","status":"' || status || '","valid":' || case when faults = '' then 'true' else 'false' end || '}' as canonical
from joined
union all
select conv_id, call_id, position, position, 0, false, 'orphan', results, false, 'no call',
  '{' || case when content is null then '' else '"content":' || cast(to_json(content) as varchar) || ',' end || '"id":"' || call_id || '","status":"orphan","valid":false}'
from firsts f where not exists (select 1 from asked a where a.conv_id = f.conv_id and a.call_id = f.call_id)
"""


def op3_simhash_near_dedup(spark: SparkSession, at: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, at, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op4_piece_encoding(spark: SparkSession, at: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encoding_digests

    return encoding_digests(_table(spark, at, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_rank_order_language(spark: SparkSession, at: str) -> DataFrame:
    from .language import of_third, profiles, with_language

    docs = _table(spark, at, "documents")
    ranked = profiles(docs.where(of_third("doc_id") != 1), "text", "lang")
    return with_language(docs.select("doc_id", "text", (of_third("doc_id") == 1).alias("held_out")), "text", ranked).drop("text")


def op6_repeat_removal(spark: SparkSession, at: str) -> DataFrame:
    from .repeats import removal_digests

    return removal_digests(_table(spark, at, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op7_term_at_a_time(spark: SparkSession, at: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k, usable

    rows = _table(spark, at, "embeddings").where(usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "v", 5).withColumnRenamed("id", "vec_id")


OP7_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256.0 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


OP8_SIZES = [256, 512, 1024, 2048, 4096]


def op8_variable_best_fit(spark: SparkSession, at: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .packing import best_fit, word_count

    return best_fit(_table(spark, at, "documents"), "doc_id", word_count(F.col("text")), OP8_SIZES).withColumnRenamed("id", "doc_id")


def op9_nn_descent(spark: SparkSession, at: str) -> DataFrame:
    from .ann import nearest

    rows = _table(spark, at, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).withColumnRenamed("id", "vec_id")


def fitted_chain(docs: DataFrame, labels: DataFrame):
    """The toxicity chain of the test tables: whether of low quality, then, seeing that, whether toxic."""
    from pyspark.sql import functions as F

    from .toxicity import fit_chain

    return fit_chain(docs, labels.withColumn("low_quality", 1 - F.col("quality")), "doc_id", "text", ["low_quality", "toxic"])


def op10_toxicity_chain(spark: SparkSession, at: str) -> DataFrame:
    from .toxicity import with_toxicity

    docs = _table(spark, at, "documents")
    return with_toxicity(docs.select("doc_id", "text"), "text", fitted_chain(docs, _table(spark, at, "labels")), "toxic").drop("text")


def op11_importance_resampling(spark: SparkSession, at: str) -> DataFrame:
    from .resampling import resample

    docs, target = _table(spark, at, "documents"), _table(spark, at, "benchmark")
    return resample(docs, target, "doc_id", "text", "text", n=1, buckets=10_000, least_words=20, percent=10, seed="2024").withColumnRenamed("id", "doc_id")


def op12_keyed_upsert(spark: SparkSession, at: str) -> DataFrame:
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    from .upsert import file_digests, new_folder, start_files, upsert

    clients, changes = _table(spark, at, "clients"), _table(spark, at, "client_changes")

    def crc(x: Column) -> Column:
        return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary"))

    def verdict(change: Column, home_first: Column) -> Column:
        h = crc(home_first) % 16
        return F.when(h > 7, "ignore").when((change.getField("op") == "D") | (crc(change.getField("change_id")) % 8 < h), "delete").otherwise("set")

    most, folder = 1 + clients.count() // 1000, new_folder(spark, "op12")
    started = start_files(clients.where(crc(F.col("client_id")) % 7 > 3), "client_id", most, folder)
    files = upsert(started, folder, clients, changes, "client_id", ["seq", "change_id"], ["source", "segment", "city", "balance"], verdict, most)
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("long")
    shown = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    told = file_digests(files, clients, "client_id", {"cents": cents, "rows_crc": crc(shown)})
    return told.withColumn("columns", F.lit(",".join(clients.columns)))


def op13_license_scan(spark: SparkSession, at: str) -> DataFrame:
    from .notices import license_report, scan_notices

    return license_report(scan_notices(_table(spark, at, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_rendezvous_shards, op2_tool_call_linking, op3_simhash_near_dedup, op4_piece_encoding, op5_rank_order_language, op6_repeat_removal, op7_term_at_a_time, op8_variable_best_fit, op9_nn_descent, op10_toxicity_chain, op11_importance_resampling, op12_keyed_upsert, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_call_linking": OP2_SQL, "op7_term_at_a_time": OP7_SQL}
