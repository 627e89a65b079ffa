"""Document queries: lineage, duplicates, clean-up, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..operators import lineage as V
from .registry import Registry, table

R = Registry()


def _docs(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select(F.col("doc_id").alias("ref_doc_id"), F.sha2("text", 256).alias("hash"), "source")


@R.query("select doc_id as ref_doc_id from documents where doc_id % 4 <> 0")
def hash_skip(spark: SparkSession, at: str) -> DataFrame:
    d = _docs(spark, at)
    stored = d.select("ref_doc_id", F.when(F.col("ref_doc_id") % 4 == 0, F.col("hash")).otherwise(F.lit("stale")).alias("hash"))
    return V.changed(d, stored).select("ref_doc_id")


@R.query("select cast(doc_id as varchar) as id from documents where source = 'src1' and doc_id % 3 = 0 and (cast(doc_id as varchar) like '1%' or cast(doc_id as varchar) like '2%')")
def prune_anti(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents").where("source = 'src1'").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    return V.to_prune(d, d.where("doc_id % 3 <> 0"), ["1", "2"]).select("id")


@R.query("select doc_id as id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def tombstone_anti(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents").select(F.col("doc_id").alias("id"), "source")
    gone = table(spark, at, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return V.not_tombstoned(d, gone, ["id"])


@R.query("select doc_id as ref_doc_id from documents where doc_id % 10 <> 0 and doc_id not in (select doc_id from labels)")
def reindex_gc(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents").select(F.col("doc_id").alias("ref_doc_id"), F.when(F.col("doc_id") % 10 == 0, 1).alias("apifed"))
    return V.reindex_garbage(d, table(spark, at, "labels").select(F.col("doc_id").alias("ref_doc_id"))).select("ref_doc_id")


def _files(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents")
    name = F.concat(F.col("source"), F.lit("/Doc "), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("x"), F.when(F.col("doc_id") % 3 == 1, "-copy").when(F.col("doc_id") % 3 == 2, "_v2").otherwise(""), F.lit(".md"))
    return d.select(name.alias("path"), F.when(F.col("doc_id") % 2 == 0, "notes").otherwise("web").alias("source"), F.col("text").alias("body"), F.col("doc_id").alias("modified"))


_FILES = "files as (select source || '/Doc ' || (doc_id // 3) || 'x' || case doc_id % 3 when 1 then '-copy' when 2 then '_v2' else '' end || '.md' as path, case when doc_id % 2 = 0 then 'notes' else 'web' end as source, text as body, doc_id as modified from documents)"
_TRIM = "regexp_replace(body, '^\\s+|\\s+$', '', 'g')"
_DUPES = f"dupes as (select path, row_number() over (partition by sha256({_TRIM}) order by modified desc, path) as nth, count(*) over (partition by sha256({_TRIM})) as n from files)"
_STEM = "trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^./]*$', '')), '(-\\d+|[-_ ]\\d{4}-\\d{2}-\\d{2}|[-_ ](copy|final|draft|old|new|v\\d+))+$', ''), '[-_\\s]+', '-', 'g'), '-')"


@R.query(f"with {_FILES}, {_DUPES} select path, nth = 1 as keep from dupes where n > 1")
def exact_dupes_keep_newest(spark: SparkSession, at: str) -> DataFrame:
    return D.exact_duplicates(_files(spark, at)).select("path", "keep")


@R.query(f"with {_FILES} select {_STEM} as stem, count(distinct path) as n, min(path) as first from files group by all having count(distinct path) > 1")
def merge_groups(spark: SparkSession, at: str) -> DataFrame:
    return D.merge_groups(_files(spark, at)).select("stem", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first"))


@R.query(f"""with {_FILES}, {_DUPES}, gone as (select path from dupes where n > 1 and nth > 1), own as (select *, {_STEM} as stem from files where source = 'notes' and path not in (select path from gone))
select 'trash' as action, count(*) as n from gone
union all select 'empty', count(*) from files where strlen({_TRIM}) <= 80 and path not in (select path from gone)
union all select 'merge', count(*) from own where stem in (select stem from own group by stem having count(*) > 1)
union all select 'compress', count(*) from own where strlen({_TRIM}) >= 12000""")
def cleanup_plan_counts(spark: SparkSession, at: str) -> DataFrame:
    return D.cleanup_plan(_files(spark, at), ["notes"], []).groupBy("action").agg(F.count("*").alias("n"))


_BITS = " + ".join(f"case when sum(case when (h >> {k}) & 1 = 1 then 1 else -1 end) > 0 then {1 << k}::bigint else 0 end" for k in range(60))
_PRINTS = f"""w as (select doc_id, source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents),
sh as (select doc_id, source, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [NULL] end) as s from w),
hs as (select doc_id, source, cast(('0x' || substr(md5(s), 1, 15)) as bigint) as h from sh),
prints as (select doc_id as id, any_value(source) as source, {_BITS} as fp from hs group by doc_id)"""


@R.query(f"with {_PRINTS} select id, fp from prints")
def simhash_md5(spark: SparkSession, at: str) -> DataFrame:
    return D.simhash_md5(table(spark, at, "documents"), "doc_id", "text")


@R.query(f"with {_PRINTS} select a.id as a, b.id as b, bit_count(xor(a.fp, b.fp)) as distance from prints a join prints b on a.source = b.source and a.id < b.id where bit_count(xor(a.fp, b.fp)) <= 12")
def near_dup_pairs(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents")
    prints = D.simhash_md5(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("id"), "source"), "id")
    return D.near_pairs(prints)


@R.query()
def near_dup_leaders(spark: SparkSession, at: str) -> DataFrame:
    """The greedy choice over FNV fingerprints; its 64-bit wrap-around has no SQL form."""
    d = table(spark, at, "documents")
    prints = D.simhash(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("id"), "source"), "id")
    return D.near_leaders(prints)


def _versions(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("ref_doc_id"), F.col("event_type").alias("chunk_index"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("replaces"))


@R.query("""with old as (select user_id, event_type, max(event_id) filter (where true) as x, count(*) as n, arg_max(cast(event_id as varchar), (ts, cast(event_id as varchar))) as last from events group by all),
new as (select distinct user_id, event_type from events where user_id % 10 = 0)
select cast(event_id as varchar) as id, user_id as ref_doc_id, event_type as chunk_index, case when user_id % 10 in (0, 5) then timestamp '2024-03-01 00:00:00' end as valid_to, null as replaces from events
union all select user_id || '#' || event_type || '#' || (n + 1), user_id, event_type, null, last from new join old using (user_id, event_type)""")
def scd2_replace(spark: SparkSession, at: str) -> DataFrame:
    """Every tenth document gets new versions of its chunks, every other fifth becomes empty."""
    x = _versions(spark, at)
    new = x.where("ref_doc_id % 10 = 0").select("ref_doc_id", "chunk_index").distinct()
    replaced = x.where("ref_doc_id % 5 = 0").select("ref_doc_id").distinct()
    return V.replace_by_doc(x, new, F.lit("2024-03-01").cast("timestamp"), replaced).drop("created_at")


@R.query("select cast(event_id as varchar) as id, row_number() over (partition by user_id, event_type order by ts, cast(event_id as varchar)) as version from events")
def chunk_versions(spark: SparkSession, at: str) -> DataFrame:
    return V.version_numbers(_versions(spark, at)).select("id", "version")


@R.query("select cast(event_id as varchar) as id from events where user_id % 10 <> 0")
def active_chunks(spark: SparkSession, at: str) -> DataFrame:
    x = _versions(spark, at)
    return V.active(V.soft_close(x, x.where("ref_doc_id % 10 = 0"), F.lit("2024-03-01").cast("timestamp"))).select("id")


def _pii_sql() -> str:
    out = "text"
    for p, m in X.PII:
        out = f"regexp_replace({out}, '{p}', '{m}', 'g')"
    return out


@R.query(f"select doc_id, md5({_pii_sql()}) as redacted from documents")
def pii_redact(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", F.md5(X.redact_pii(F.col("text"))).alias("redacted"))


def _leak_sql() -> str:
    hits = ", ".join("case when regexp_matches(text, '{}') then '{}' end".format(p.replace("'", "''"), r) for p, r in X.LEAKS)
    first = f"list_filter([{hits}], lambda x: x is not null)"
    return f"with a as (select doc_id, text, {first} as r from documents) select doc_id, case when regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' then 'empty_query' when length(text) > 2000 then 'query_too_long' else array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') end as reasons from a"


@R.query(_leak_sql())
def leak_guard_reasons(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", F.array_join(X.leak_reasons(F.col("text")), ",").alias("reasons"))


@R.query(f"select doc_id, md5('{X.UNTRUSTED_HEAD}' || text || '{X.UNTRUSTED_TAIL}') as block from documents")
def untrusted_block(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", F.md5(X.data_block(F.col("text"))).alias("block"))


@R.query("select doc_id, regexp_replace(regexp_replace(source || '/' || doc_id, '[^A-Za-z0-9\\-_.]', '_', 'g'), '$', '-' || substr(sha256(source || '/' || doc_id), 1, 8)) as file, case when doc_id % 2 = 0 then doc_id || '#0' else doc_id || '#0#' || (doc_id % 2 + 1) end as chunk from documents")
def identifiers(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents")
    raw = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", X.sanitize_id(raw).alias("file"), X.versioned_chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("doc_id") % 2).alias("chunk"))


@R.query("with n as (select p_partkey, lower(trim(p_name)) as n, lower(p_type) as k from part) select p_partkey, trim(regexp_replace(lower(n || '|' || k), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha1(strlen(n) || ':' || n || ';' || strlen(k) || ':' || k || ';'), 1, 8) as id from n")
def entity_ids(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", X.entity_id(F.col("p_name"), F.col("p_type")).alias("id"))


@R.query("select 'documents' as name, count(*) as n from documents union all select 'events', count(*) from events union all select 'labels', count(*) from labels")
def index_stats(spark: SparkSession, at: str) -> DataFrame:
    return V.index_stats({k: table(spark, at, k) for k in ("documents", "events", "labels")})
