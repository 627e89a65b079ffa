"""Queries of single operators: views, communities, run records, filters of questions, identifiers and written values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import dot
from ..operators import evaluate as E
from ..operators import filters as Q
from ..operators import graph as G
from ..operators import history, lexical
from ..operators import lineage as V
from ..operators import retrieve, views
from ..operators.ask import levels
from ..sources.parse import html_markdown
from .adapters import CHUNKS, chunks
from .graph import FACTS, _facts
from .registry import Registry, table

R = Registry()


@R.query("select doc_id, source, lang from documents where doc_id in (3, 7, 11, 190)")
def point_lookup(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").where(F.col("doc_id").isin(3, 7, 11, 190)).select("doc_id", "source", "lang")


@R.query("select 'o' || o_orderkey as path, o_orderpriority as source, o_orderdate as updated_at from orders where o_orderpriority = '1-URGENT' order by updated_at desc, path limit 40 offset 10")
def document_page(spark: SparkSession, at: str) -> DataFrame:
    o = table(spark, at, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("updated_at"))
    return views.document_page(o, "1-URGENT", 10, 40)


@R.query("select cast(doc_id as varchar) as id from documents where doc_id % 4 = 3")
def real_documents(spark: SparkSession, at: str) -> DataFrame:
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("global:"), i)).when(k == 1, F.concat(F.lit("community:"), i)).when(k == 2, "set-summary").otherwise(i)
    return views.real_documents(table(spark, at, "documents").select(name.alias("id")))


@R.query(f"with {FACTS} select id from facts where cast(substr(chunk, 2) as int) % 10 = 3")
def document_relations(spark: SparkSession, at: str) -> DataFrame:
    owned = spark.range(50).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), (F.col("id") % 10).cast("string").alias("ref_doc_id"))
    return views.document_relations(_facts(spark, at), owned, "3").select("id")


def _nations(spark: SparkSession, at: str) -> DataFrame:
    """Nations as communities of their suppliers."""
    s = table(spark, at, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("m"))
    return s.groupBy("id").agg(F.collect_list("m").alias("members")).withColumn("stale", F.lit(False))


def _suppliers(spark: SparkSession, at: str, where: str) -> DataFrame:
    return table(spark, at, "supplier").where(where).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey", "s_nationkey")


@R.query("select 'n' || s_nationkey as id from supplier group by s_nationkey having max(s_acctbal) <= 4000")
def orphan_communities(spark: SparkSession, at: str) -> DataFrame:
    return G.orphan_communities(_nations(spark, at), _suppliers(spark, at, "s_acctbal > 4000")).select("id")


@R.query("select 'n' || s_nationkey as id, count(*) as hits from supplier where s_acctbal > 4000 group by s_nationkey")
def communities_of_entities(spark: SparkSession, at: str) -> DataFrame:
    return G.communities_for(_nations(spark, at), _suppliers(spark, at, "s_acctbal > 4000"))


@R.query("""with m as (select 'n' || s_nationkey as community, 's' || s_suppkey as id, 'd' || (s_suppkey % 7) as chunk from supplier),
r as (select 's' || l_suppkey as src, 's' || (l_suppkey + l_linenumber) as dst, 'o' || (l_orderkey % 50) as chunk from lineitem),
c as (select community, chunk from m union select a.community, r.chunk from r join m a on a.id = r.src join m b on b.id = r.dst where a.community = b.community)
select community, array_to_string(list_sort(list(distinct chunk)), ',') as chunks from c group by community""")
def community_chunks(spark: SparkSession, at: str) -> DataFrame:
    s = _suppliers(spark, at, "true")
    members = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("community"), "id")
    entities = s.select("id", F.array(F.concat(F.lit("d"), (F.col("s_suppkey") % 7).cast("string"))).alias("source_chunks"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    relations = table(spark, at, "lineitem").select(name(F.col("l_suppkey")).alias("src"), name(F.col("l_suppkey") + F.col("l_linenumber")).alias("dst"), F.array(F.concat(F.lit("o"), (F.col("l_orderkey") % 50).cast("string"))).alias("source_chunks"))
    return G.community_chunks(members, entities, relations).withColumn("chunks", F.array_join("chunks", ","))


@R.query("with s as (select s_suppkey, 'n' || s_nationkey as id, s_suppkey % 4 as component from supplier), hit as (select distinct component from s where s_suppkey in (3, 8)) select id, max(case when component in (select component from hit) then 1 else 0 end) = 1 as stale from s group by id")
def stale_communities(spark: SparkSession, at: str) -> DataFrame:
    s = _suppliers(spark, at, "true").withColumn("component", F.col("s_suppkey") % 4)
    return views.stale_communities(_nations(spark, at), s.select("id", "component"), s.where("s_suppkey in (3, 8)")).select("id", "stale")


@R.query("with r as (select doc_id % 2 = 0 as a, quality = 1 as b, toxic = 0 as ok, doc_id % 3 = 0 as ch from labels) select count(*) filter (a) as affected, count(*) filter (not a) as control, count(*) filter (a and b and ok) as updated, count(*) filter (a and not ok) as not_updated, count(*) filter (not a and ok and not ch) as stable, count(*) filter (not a and not ok) as regressed from r")
def actualization_summary(spark: SparkSession, at: str) -> DataFrame:
    y = table(spark, at, "labels")
    return E.actualization(y.select((F.col("doc_id") % 2 == 0).alias("affected"), (F.col("quality") == 1).alias("before_ok"), (F.col("toxic") == 0).alias("after_ok"), (F.col("doc_id") % 3 == 0).alias("changed")))


@R.query("with r as (select s_suppkey as id, unnest([0, 1, 2]) as pos, unnest([s_suppkey, s_suppkey + 1, s_suppkey * 2]) as public from supplier) select id, string_agg(cast(public + 1000 as varchar), ',' order by pos) as ids from r join part on p_partkey = public where p_partkey % 3 <> 0 group by id")
def translated_ids(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, at, "supplier").select(k.alias("id"), F.array(k, k + 1, k * 2).alias("ids"))
    mapping = table(spark, at, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("public"), (F.col("p_partkey") + 1000).alias("private"))
    return E.translate_ids(rows, mapping).select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@R.query("select item_id as question_id, item_id % 2 = 0 as matched from benchmark")
def submission_join(spark: SparkSession, at: str) -> DataFrame:
    gold = table(spark, at, "benchmark").select(F.col("item_id").alias("question_id"))
    return E.submission_scores(gold, gold.where("question_id % 2 = 0")).select("question_id", "matched")


@R.query(f"with {CHUNKS}, f as (select ref_doc_id as doc, min(id) as new from chunks group by 1) select id as old, new from chunks join f on superseded_by = doc")
def superseded_pairs(spark: SparkSession, at: str) -> DataFrame:
    return E.superseded_pairs(chunks(spark, at).withColumn("rank", F.col("id")))


@R.query("select user_id, round((least(count(*) / 10, 1.0) + greatest(least(avg(value / 100), 1.0), 0.0)) / 2, 6) as coverage from events group by user_id")
def evidence_coverage(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events").select("user_id", (F.col("value") / 100).alias("score"))
    return E.deterministic_coverage(e, "user_id", 10).withColumn("coverage", F.round("coverage", 6))


@R.query("with m as (select l_partkey as id, l_returnflag as name, case when l_linenumber % 3 = 0 then l_linestatus else '' end as description, (l_orderkey, l_linenumber, l_shipdate, l_extendedprice) as seq from lineitem) select id, arg_min(name, seq) as name, coalesce(arg_min(description, seq) filter (where description <> ''), '') as description from m group by id")
def batch_entities(spark: SparkSession, at: str) -> DataFrame:
    x = table(spark, at, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.lit("part").alias("type"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linestatus")).otherwise("").alias("description"), F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").alias("seq"))
    return G.batch_entities(x).select("id", "name", "description")


@R.query("select distinct 'e' || l_partkey as src, 'e' || l_suppkey as dst, lower(l_returnflag) as type, 1.0::double as weight from lineitem where l_partkey <> l_suppkey and l_partkey % 2 = 0 and l_suppkey % 2 = 0 and l_suppkey in (select p_partkey from part)")
def batch_relations(spark: SparkSession, at: str) -> DataFrame:
    word = lambda c: F.concat(F.lit(" Name "), F.col(c).cast("string"), F.lit(" "))
    raw = table(spark, at, "lineitem").select(word("l_partkey").alias("source"), word("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"))
    names = table(spark, at, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("NAME "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"))
    return G.batch_relations(raw, names)


@R.query("select 'r' || event_id as id, cast(case when event_id % 3 = 0 then 2 else 1 end as double) as weight from events where event_id % 3 <> 1 or event_id % 2 = 0")
def chunks_removed_from_relations(spark: SparkSession, at: str) -> DataFrame:
    """Relations of two chunks, some lose one and some both; those without any go."""
    k = F.col("event_id")
    own = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.when(k % 2 == 0, F.array(F.lit("gone"), F.lit("b"))).otherwise(F.array(F.lit("gone")))).otherwise(F.array(F.lit("c"), F.lit("gone")))
    x = table(spark, at, "events").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), own.alias("source_chunks"), F.size(own).cast("double").alias("weight"))
    return G.prune_orphans(G.remove_chunks(x, ["gone"])).select("id", "weight")


@R.query(f"with {FACTS}, kept as (select * from facts where src not in ('u1', 'u2') and dst not in ('u1', 'u2')), e as (select distinct src as id from facts where src not in ('u1', 'u2')), d as (select id, count(*) as degree from (select src as id from kept where valid_to is null union all select dst from kept where valid_to is null and src <> dst) group by id) select id, coalesce(degree, 0) as degree from e left join d using (id)")
def entities_deleted(spark: SparkSession, at: str) -> DataFrame:
    x = _facts(spark, at)
    entities = x.select(F.col("src").alias("id")).distinct().withColumn("degree", F.lit(-1).cast("long"))
    return G.delete_entities(entities, x, spark.sql("select * from values ('u1'), ('u2') as t(id)"))[0].select("id", "degree")


@R.query("select event_id as id, case when event_id % 5 = 0 then 'new' when event_id % 7 = 0 then null when event_id % 11 = 0 then 'other' end as superseded_by from events")
def supersede_marks(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("event_id")
    x = table(spark, at, "events").select(k.alias("id"), F.when(k % 7 == 0, "new").when(k % 11 == 0, "other").alias("superseded_by"))
    return V.supersede_marks(x, x.where("id % 5 = 0"), F.lit("new"))


@R.query("select user_id as run_id, event_id as content, cast(row_number() over (partition by user_id order by event_id % 2, event_id) as int) as seq from events")
def appended_messages(spark: SparkSession, at: str) -> DataFrame:
    """Messages of even number stand stored, the others come in and are numbered on."""
    e = table(spark, at, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("content"), F.col("event_id").alias("order"))
    n = F.expr("cast(row_number() over (partition by run_id order by content) as int)")
    return V.append_messages(e.where("content % 2 = 0").withColumn("seq", n), e.where("content % 2 = 1")).select("run_id", "content", "seq")


@R.query("select case when o_orderstatus = 'O' then 'interrupted' else o_orderstatus end as status, count(*) as n from orders group by 1")
def interrupted_runs(spark: SparkSession, at: str) -> DataFrame:
    o = table(spark, at, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"))
    return V.interrupt_running(o).groupBy("status").agg(F.count("*").alias("n"))



def _rows(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").select("event_id", F.col("event_type").alias("source"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string")).alias("metadata"))


@R.query("select event_id from events where user_id = 5 and value > 20")
def qualifier_json(spark: SparkSession, at: str) -> DataFrame:
    spec = Q.parse_qualifiers('{"equal": {"user": "5", " ": "x"}, "numeric": [{"field": "value", "op": ">", "value": 20}, {"field": "value", "op": "like", "value": 1}]}')
    return _rows(spark, at).where(Q.filter_expr(spec)).select("event_id")


@R.query("select event_id from events where false")
def contradicting_qualifiers(spark: SparkSession, at: str) -> DataFrame:
    spec = Q.narrow(Q.Filter(equal={"user": "5"}), Q.Filter(equal={"user": "6"}))
    return _rows(spark, at).where(Q.filter_expr(spec)).select("event_id")


@R.query("select event_id, 'kept' as way from events where event_type = 'click' and user_id = 5 union all select event_id, 'relaxed' from events where event_type = 'click'")
def qualifier_fallback(spark: SparkSession, at: str) -> DataFrame:
    """A qualifier that leaves rows holds; one that leaves none gives way."""
    x, base = _rows(spark, at), Q.Filter(sources=("click",))
    one = Q.with_fallback(x, base, Q.Filter(equal={"user": "5"})).select("event_id", F.lit("kept").alias("way"))
    return one.union(Q.with_fallback(x, base, Q.Filter(equal={"user": "nobody"})).select("event_id", F.lit("relaxed")))


@R.query("select distinct source as name from documents where source like 'src1%' or source = 'src3'")
def collection_sources(spark: SparkSession, at: str) -> DataFrame:
    s = table(spark, at, "documents").select(F.when(F.col("source").startswith("src1"), "ones").otherwise("rest").alias("type"), F.col("source").alias("name")).distinct()
    members = spark.sql("select * from values ('all', 'ones', '*'), ('all', 'rest', 'src3'), ('other', 'rest', '*') as t(collection, type, name)")
    return Q.expand_collection("all", members, s)


@R.query(f"with {CHUNKS} select id, ref_doc_id, n_chars as score from chunks qualify row_number() over (partition by ref_doc_id order by n_chars desc, id) = 1")
def set_mode_union(spark: SparkSession, at: str) -> DataFrame:
    x = chunks(spark, at).select("id", "ref_doc_id", F.element_at("metadata", "n_chars").cast("long").alias("score"))
    return retrieve.set_union(x)


@R.query("select e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) as s from embeddings e, embeddings q where q.vec_id = 3")
def drift_scores(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "embeddings")
    # One row, the question.
    return e.crossJoin(F.broadcast(e.where("vec_id = 3").select(F.col("embedding").alias("q")))).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("s"))


@R.query("select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('day', ts) end as at from events")
def chat_times(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(F.lit(" "), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("yesterday")
    return table(spark, at, "events").select("event_id", X.chat_time(raw).cast("timestamp_ntz").alias("at"))


@R.query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, 'law' || o_custkey as law from orders union all select o_orderkey, '2020-01-02', 'x' from orders where o_orderkey % 2 = 0")
def amendment_pairs(spark: SparkSession, at: str) -> DataFrame:
    d = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(":law"), F.col("o_custkey").cast("string"))
    raw = F.concat(F.lit("["), d, F.lit(" "), d, F.lit(" bad:one"), F.when(F.col("o_orderkey") % 2 == 0, " 2020-01-02:x").otherwise(""), F.lit("]"))
    x = table(spark, at, "orders").select("o_orderkey", F.explode(X.amendments(raw)).alias("a"))
    return x.select("o_orderkey", F.col("a.date").cast("string").alias("date"), F.col("a.law").alias("law"))


_ROMAN = ["I", "IV", "IX", "XIV", "XL", "xc", "CD", "MCMXCIV", "12", "abc"]


@R.query("select p_partkey, [1, 4, 9, 14, 40, 90, 400, 1994, 12, null][(p_partkey % 10) + 1] as n from part")
def roman_numbers(spark: SparkSession, at: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(r) for r in _ROMAN]), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, at, "part").select("p_partkey", X.roman_number(raw).alias("n"))


@R.query("select s_suppkey, case when s_suppkey = s_nationkey then cast(s_suppkey as varchar) else s_suppkey || ',' || s_nationkey end as ids from supplier")
def flattened_ids(spark: SparkSession, at: str) -> DataFrame:
    raw = F.format_string("[[%d, [%d]], %d]", "s_suppkey", "s_nationkey", "s_suppkey")
    return table(spark, at, "supplier").select("s_suppkey", F.array_join(X.flatten_text_ids(raw), ",").alias("ids"))


@R.query("select event_id, case event_type when 'view' then 0 when 'click' then 1 else 2 end as rank, case when value < 60 then 'now' when value < 3600 then cast(floor(value / 60) as bigint) || 'm' else 'h' end as age from events")
def authority_and_age(spark: SparkSession, at: str) -> DataFrame:
    seen = F.when(F.col("event_type") == "view", " Approved").when(F.col("event_type") == "click", "NOTES").otherwise(F.col("event_type"))
    return table(spark, at, "events").select("event_id", X.authority_rank(seen).alias("rank"), X.recency(F.col("value")).alias("age"))


@R.query("""select o_orderkey, '{"k": [' || o_orderkey || ']}' as json from orders""")
def code_fences(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n{\"k\": ["), k, F.lit(",]}\n```"))).otherwise(F.concat(F.lit(' {"k": ['), k, F.lit("],}\n")))
    return table(spark, at, "orders").select("o_orderkey", X.strip_code_fence(raw).alias("json"))


@R.query("""select doc_id, sha256('{"Kind":"' || coalesce(lang, '-') || '","Body":"' || source || '","Frontmatter":{"n":"' || n_chars || '"}}') as hash from documents""")
def document_hashes(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", X.document_hash(F.coalesce("lang", F.lit("-")), F.col("source"), F.create_map(F.lit("n"), F.col("n_chars").cast("string"))).alias("hash"))


@R.query("select doc_id, source || '/a.b/Doc ' || doc_id as ref, source as own from documents")
def reference_ids(spark: SparkSession, at: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/a.b/Doc "), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, at, "documents").select("doc_id", X.without_extension(path).alias("ref"), X.first_segment(path).alias("own"))


@R.query("select s_suppkey, 'c-' || substr(sha1('2|a,s' || s_suppkey || '|a|s' || s_suppkey || '|knows|' || printf('%.6f', s_acctbal) || '|why'), 1, 16) as id from supplier")
def community_ids(spark: SparkSession, at: str) -> DataFrame:
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    edge = F.struct(name.alias("src"), F.lit("a").alias("dst"), F.lit("knows").alias("type"), F.col("s_acctbal").alias("weight"), F.lit("why").alias("description"))
    return table(spark, at, "supplier").select("s_suppkey", X.community_id(F.lit(2), F.array(name, F.lit("a")), F.array(edge)).alias("id"))


@R.query("""with recursive t as (select distinct conv_id, turn from conversations where conv_id is not null and turn is not null),
d as (select t.conv_id, t.turn, p.turn as dep from t join t p on p.conv_id = t.conv_id and p.turn in (t.turn - 1, t.turn - 3) where t.turn % 4 <> 0),
w as (select conv_id, turn, 0 as level from t union select d.conv_id, d.turn, w.level + 1 from w join d on d.conv_id = w.conv_id and d.dep = w.turn)
select conv_id, cast(turn as varchar) as id, max(level) as level from w group by all""")
def question_dag_levels(spark: SparkSession, at: str) -> DataFrame:
    """Turns as questions that need the turn before and the third before; a level is the longest way to one that needs none."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        turns = sorted({int(t) for t in f["turn"]})
        # Edges to turns that do not exist, or to later ones, are for levels() to leave out.
        deps = {str(t): [str(t - 1), str(t - 3), "none", str(t)] if t % 4 else [] for t in turns}
        got = levels([str(t) for t in turns], deps)
        return pd.DataFrame({"conv_id": f["conv_id"].iloc[0], "id": list(got), "level": list(got.values())})

    t = table(spark, at, "conversations").select("conv_id", "turn").dropna().distinct()
    return t.groupBy("conv_id").applyInPandas(run, "conv_id long, id string, level int")


@R.query()
def html_text(spark: SparkSession, at: str) -> DataFrame:
    """Pages as Markdown; a parser's work, tested on pages written by hand."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [html_markdown(h or "", u or "") for h, u in zip(f["html"], f["url"], strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "title": [g[0] for g in got], "body": [g[1] for g in got]})

    return table(spark, at, "pages").select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, body string")


def _searches(spark: SparkSession, at: str) -> DataFrame:
    """Events as searches; purchases are rated up, errors of every other user down, some without the time of it."""
    e = table(spark, at, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    vote = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, -1).otherwise(0)
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.array(F.col("user_id").cast("string")).alias("document_ids"), ts.alias("created_at"), vote.alias("feedback"), F.when(F.col("event_id") % 2 == 0, ts + F.expr("interval 1 hour")).alias("feedback_at"))


@R.query("select event_id as id, event_type as query, ts as created_at from events order by ts desc, event_id desc limit 20")
def history_newest(spark: SparkSession, at: str) -> DataFrame:
    return history.newest(_searches(spark, at), 0).select("id", "query", "created_at")


@R.query("""select event_id as id, event_type as query, cast(user_id as varchar) as document, case when event_id % 3 = 0 then 'relevant' else 'not_relevant' end as label,
case when event_id % 2 = 0 then ts + interval 1 hour else ts end as labelled_at from events where event_id % 3 <> 2""")
def labelled_examples(spark: SparkSession, at: str) -> DataFrame:
    return history.labelled(_searches(spark, at)).select("id", "query", F.array_join("document_ids", ",").alias("document"), "label", "labelled_at")


@R.query("""with c as (select l_orderkey as q, l_partkey as a from lineitem), k as (select distinct q, a from c where a % 10 < 8),
m as (select 'nhsr' as metric, (select count(*) from k where a % 10 < 6) as passed, (select count(*) from k) + (select count(*) from c where a % 10 = 9) as total
union all select 'srr', count(*) filter (where q % 2 = 0), count(*) from k where a % 3 = 0
union all select 'lct', count(*) filter (where o_orderkey % 5 > 0), count(*) from orders)
select metric, cast(passed as bigint) as passed, cast(total as bigint) as total, passed / total as rate from m""")
def legal_metrics(spark: SparkSession, at: str) -> DataFrame:
    """Order lines as citations of parts: of the last digits 0 to 7 known articles, 6 and 7 out of force, 8 rulings, 9 unknown."""
    p = F.col("p_partkey")
    parts = table(spark, at, "part")
    articles = parts.where(p % 10 < 8).select(p.alias("article"), (p % 10 < 6).alias("current"))
    cited = table(spark, at, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("article"))
    judged = cited.where("article % 3 = 0").select("question_id", "article", (F.col("question_id") % 2 == 0).alias("passed")).distinct()
    claims = table(spark, at, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 5 > 0).alias("passed"))
    return E.legal_report(cited, articles, parts.where(p % 10 == 8).select(p.alias("article")), judged, claims)


@R.query("select max(o_orderdate) as as_of from orders")
def legal_as_of(spark: SparkSession, at: str) -> DataFrame:
    return E.legal_as_of(table(spark, at, "orders").select(F.col("o_custkey").alias("article"), F.col("o_orderdate").alias("date")))


@R.query("select cast(doc_id as varchar) as id, source, 'Q ' || doc_id as question, 'lang ' || coalesce(lang, '-') as expected from documents where doc_id % 2 = 0 and doc_id % 3 = 0 and doc_id % 5 <> 0")
def golden_issues(spark: SparkSession, at: str) -> DataFrame:
    d = F.col("doc_id")
    x = table(spark, at, "documents").select(
        d.cast("string").alias("id"), "source", F.when(d % 2 == 0, "issue").otherwise("md").alias("kind"), F.when(d % 5 == 0, " ").otherwise(F.concat(F.lit(" Q "), d.cast("string"))).alias("title"),
        F.concat(F.lit("lang "), F.coalesce("lang", F.lit("-")), F.lit("\n")).alias("body"), F.create_map(F.lit("state"), F.when(d % 3 == 0, "closed").otherwise("open")).alias("frontmatter"),
    )
    return E.golden_set(x)


@R.query("""select p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: '"' || t || '"'), ' OR ') as expression from part""")
def match_expressions(spark: SparkSession, at: str) -> DataFrame:
    raw = F.concat(F.lit('"('), F.col("p_name"), F.lit('*" )'))
    return table(spark, at, "part").select("p_partkey", lexical.match_expression(raw).alias("expression"))


_PLAIN = ["id", "src", "dst", "type", "weight", "confidence", "valid_from", "valid_to", "source_chunks"]


def _no_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, name string, type string, description string, source_chunks array<string>, degree long")


@R.query(f"with {FACTS} select id, case when id % 10 = 0 then 5.0 else 1.0 end as weight, 0.5 as confidence, valid_from, case when id % 20 <> 0 then valid_to end as valid_to from facts")
def relations_put(spark: SparkSession, at: str) -> DataFrame:
    x = _facts(spark, at).select(_PLAIN)
    new = x.where("id % 10 = 0").withColumns({"weight": F.lit(5.0), "confidence": F.lit(0.0), "valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "reopen": F.col("id") % 20 == 0})
    return G.put_relations(_no_entities(spark), x, new)[1].select("id", "weight", "confidence", "valid_from", "valid_to")


_UPSERTED = f"""{FACTS}, new as (select id - 1 as id, src, dst, type, valid_from, valid_to, chunk from facts where id % 100 = 0),
old as (select f.id, f.src, f.dst, f.valid_from, f.chunk, coalesce(f.valid_to, (select min(n.valid_from) from new n where n.src = f.src and n.type = f.type and n.dst <> f.dst and n.valid_from > f.valid_from)) as valid_to from facts f where f.id % 100 <> 0),
r as (select coalesce(o.id, n.id) as id, coalesce(o.src, n.src) as src, coalesce(o.dst, n.dst) as dst, case when o.id is null or n.id is null then 1.0 else 2.0 end as weight,
  case when o.id is null then n.valid_to else coalesce(o.valid_to, case when n.valid_to > o.valid_from then n.valid_to end) end as valid_to, concat_ws(',', o.chunk, n.chunk) as chunks from old o full outer join new n on o.id = n.id)"""


def _upserted(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth fact as a new one, under the id of the fact before it."""
    x = _facts(spark, at).select(_PLAIN)
    new = x.where("id % 100 = 0").withColumns({"id": F.col("id") - 1, "seq": F.col("id") + 1})
    users = x.where("id % 100 <> 0").select(F.col("src").alias("id"), F.lit("").alias("name"), F.lit("").alias("type"), F.lit("").alias("description"), F.array(F.lit("c")).alias("source_chunks"), F.lit(-1).cast("long").alias("degree")).distinct()
    return G.upsert_relations(users, x.where("id % 100 <> 0"), new)


@R.query(f"with {_UPSERTED} select id, src, dst, weight, valid_to, chunks from r")
def relations_upserted(spark: SparkSession, at: str) -> DataFrame:
    return _upserted(spark, at)[1].select("id", "src", "dst", "weight", "valid_to", F.array_join("source_chunks", ",").alias("chunks"))


@R.query(f"with {_UPSERTED} select u.id, case when u.id in (select src from new) then (select count(*) from r where r.src = u.id and r.valid_to is null) else -1 end as degree from (select distinct src as id from facts where id % 100 <> 0) u")
def degrees_after_upsert(spark: SparkSession, at: str) -> DataFrame:
    return _upserted(spark, at)[0].select("id", "degree")
