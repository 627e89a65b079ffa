"""Graph queries: events as facts over time, order lines as weighted relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.modularity import modularity
from .registry import Registry, table

R = Registry()


def _facts(spark: SparkSession, at: str) -> DataFrame:
    """Events as relations of a user to a number, in force for ten days, every third one open."""
    e = table(spark, at, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst"), F.col("event_type").alias("type"),
        F.lit(1.0).alias("weight"), F.lit(0.5).alias("confidence"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 10 days")).alias("valid_to"),
        F.array(F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string"))).alias("source_chunks"), F.col("event_id").alias("seq"),
    )


FACTS = "facts as (select event_id as id, 'u' || user_id as src, 'k' || json_extract_string(props, '$.k') as dst, event_type as type, ts as valid_from, case when event_id % 3 <> 0 then ts + interval 10 days end as valid_to, 'c' || (event_id % 50) as chunk from events)"


def _relations(lines: DataFrame) -> DataFrame:
    """Order lines as relations of a part to a supplier, weighted by quantity."""
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.lit(None).cast("timestamp").alias("valid_to"),
    )


def _trade(spark: SparkSession, at: str) -> DataFrame:
    """The relations of all order lines, as TRADE has them."""
    return _relations(table(spark, at, "lineitem"))


TRADE = "trade as (select l_orderkey || '-' || l_linenumber as id, 'p' || l_partkey as src, 's' || l_suppkey as dst, l_returnflag as type, l_quantity as weight from lineitem)"


@R.query(f"with {FACTS} select id, src, dst from facts where valid_from <= timestamp '2024-01-15 00:00:00' and (valid_to is null or valid_to > timestamp '2024-01-15 00:00:00')")
def relations_as_of(spark: SparkSession, at: str) -> DataFrame:
    return G.as_of(_facts(spark, at), F.lit("2024-01-15").cast("timestamp")).select("id", "src", "dst")


@R.query(f"with {FACTS}, d as (select distinct src, type, cast(valid_from as date) as date from facts), n as (select *, lead(date) over (partition by src, type order by date) as valid_to from d) select f.id, cast(n.date as varchar) as date, cast(n.valid_to as varchar) as valid_to from facts f join n on f.src = n.src and f.type = n.type and cast(f.valid_from as date) = n.date")
def amend_windows(spark: SparkSession, at: str) -> DataFrame:
    x = _facts(spark, at).select(F.concat_ws("/", "src", "type").alias("article"), F.col("id").alias("law"), F.col("valid_from").cast("date").alias("date"))
    return G.amendment_windows(x).select(F.col("law").alias("id"), F.col("date").cast("string").alias("date"), F.col("valid_to").cast("string").alias("valid_to"))


@R.query(f"with {FACTS} select f.id, coalesce(f.valid_to, (select min(o.valid_from) from facts o where o.src = f.src and o.type = f.type and o.dst <> f.dst and o.valid_from > f.valid_from)) as valid_to from facts f")
def conflict_close(spark: SparkSession, at: str) -> DataFrame:
    return G.close_conflicts(_facts(spark, at)).select("id", "valid_to")


@R.query(f"with {FACTS}, new as (select src, type, dst, valid_from from facts where id % 100 = 0), old as (select * from facts where id % 100 <> 0) select o.id, coalesce(o.valid_to, (select min(n.valid_from) from new n where n.src = o.src and n.type = o.type and n.dst <> o.dst and n.valid_from > o.valid_from)) as valid_to from old o")
def conflict_close_on_arrival(spark: SparkSession, at: str) -> DataFrame:
    x = _facts(spark, at)
    return G.close_on_arrival(x.where("id % 100 <> 0"), x.where("id % 100 = 0"), F.current_timestamp()).select("id", "valid_to")


@R.query(f"with {FACTS} select id, count(*) as degree from (select src as id from facts where valid_to is null union all select dst from facts where valid_to is null and src <> dst) group by id")
def open_degree(spark: SparkSession, at: str) -> DataFrame:
    return G.open_degrees(_facts(spark, at))


def _mentions(spark: SparkSession, at: str) -> DataFrame:
    x = table(spark, at, "lineitem")
    return x.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("string")).otherwise("").alias("name"), F.lit("part").alias("type"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("").alias("description"), F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("source_chunks"), F.lit(0).alias("degree"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").alias("seq"),
    )


@R.query("with m as (select 'p' || l_partkey as id, case when l_linenumber % 2 = 0 then strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') else '' end as name, case when l_returnflag = 'R' then l_linestatus else '' end as description, 'o' || l_orderkey as chunk, (l_orderkey, l_linenumber, l_shipdate, l_extendedprice) as seq from lineitem) select id, coalesce(arg_max(name, seq) filter (where name <> ''), '') as name, coalesce(arg_max(description, seq) filter (where description <> ''), '') as description, count(distinct chunk) as chunks, arg_min(chunk, seq) as first from m group by id")
def entity_merge(spark: SparkSession, at: str) -> DataFrame:
    x = G.merge_entities(_mentions(spark, at))
    return x.select("id", "name", "description", F.size("source_chunks").cast("long").alias("chunks"), F.get("source_chunks", F.lit(0)).alias("first"))


@R.query(f"with {FACTS} select src || dst || type as id, cast(count(*) as double) as weight, count(distinct chunk) as chunks, min(valid_from) as valid_from from facts group by all")
def relation_merge(spark: SparkSession, at: str) -> DataFrame:
    x = _facts(spark, at).withColumns({"id": F.concat("src", "dst", "type"), "seq": F.unix_micros(F.col("valid_from").cast("timestamp"))})
    return G.merge_relations(x).select("id", "weight", F.size("source_chunks").cast("long").alias("chunks"), "valid_from")


@R.query(f"with {TRADE} select least(src, dst) as u, greatest(src, dst) as v, sum(case when weight <= 0 then 1 else weight end) as weight from trade where src <> dst group by all")
def edge_consolidation(spark: SparkSession, at: str) -> DataFrame:
    return G.consolidated_edges(_trade(spark, at))


_EDGES = f"{TRADE}, edges as (select distinct src as a, dst as b from trade union select dst, src from trade)"


@R.query(f"with recursive {_EDGES}, walk as (select 's1' as id, 0 as hop union select e.b, w.hop + 1 from walk w join edges e on e.a = w.id where w.hop < 2) select 's1' as seed, id, cast(min(hop) as integer) as hop from walk group by id having min(hop) > 0")
def k_hop_neighbors(spark: SparkSession, at: str) -> DataFrame:
    return G.neighbours(_trade(spark, at), spark.sql("select 's1' as id"), 2)


@R.query(f"with {TRADE}, one as (select * from trade where src in ('s1', 's2') or dst in ('s1', 's2')), pairs as (select seed, src, dst, weight from (select 's1' as seed, * from trade where src = 's1' or dst = 's1' union all select 's2', * from trade where src = 's2' or dst = 's2')) select id, sum(weight) as score from (select src as id, weight from pairs union all select dst, weight from pairs) where id not in ('s1', 's2') group by id")
def neighbor_score(spark: SparkSession, at: str) -> DataFrame:
    got = G.neighbour_scores(_trade(spark, at), spark.sql("select * from values ('s1'), ('s2') as t(id)"), 1)
    return got.where("id not in ('s1', 's2')")


_ENT = f"{TRADE}, ents as (select id, count(*) as degree from (select src as id from trade union all select dst from trade) group by id), nodes as (select id, degree from ents where id like 's%' and degree >= 3 order by degree desc, id limit 30)"


def _entities(spark: SparkSession, at: str) -> DataFrame:
    d = G.open_degrees(_trade(spark, at))
    return d.select("id", F.col("id").alias("name"), F.substring("id", 1, 1).alias("type"), F.lit("").alias("description"), "degree")


@R.query(f"with {_ENT} select id, degree from nodes")
def graph_filtered_view(spark: SparkSession, at: str) -> DataFrame:
    return G.filtered_view(_entities(spark, at), _trade(spark, at), kind="s", least_degree=3, limit=30)[0].select("id", "degree")


@R.query(f"with {FACTS}, mine as (select *, case when src = 'u7' then dst else src end as neighbour from facts where src = 'u7' or dst = 'u7') select type, neighbour, row_number() over (partition by type order by valid_from desc, neighbour, id) as nth, count(*) over (partition by type) as total from mine qualify nth <= 5")
def edge_groups(spark: SparkSession, at: str) -> DataFrame:
    return G.edge_groups(_facts(spark, at), F.lit("u7"), 5).select("type", "neighbour", "nth", "total")


_COMP = "links as (select distinct 'c' || o_custkey as a, 'o' || o_orderkey as b from orders)"


def _links(spark: SparkSession, at: str) -> DataFrame:
    """Each customer with each of its orders."""
    o = table(spark, at, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst")).distinct()


@R.query(f"with recursive {_COMP}, both_ways as (select a, b from links union select b, a from links), nodes as (select distinct a as id from both_ways), reach as (select id, id as r from nodes union select r.id, e.b from reach r join both_ways e on e.a = r.r) select id, min(r) as component from reach group by id")
def connected_components(spark: SparkSession, at: str) -> DataFrame:
    x = _links(spark, at)
    ids = x.select(F.col("src").alias("id")).union(x.select("dst")).distinct()
    return G.connected(ids, x)


def _label_sql(rounds: int = 20) -> str:
    """The synchronous rounds written out; a round that changes nothing leaves all that follow alike."""
    edges = "select least(src, dst) as u, greatest(src, dst) as v, sum(case when weight <= 0 then 1 else weight end) as weight from trade where src <> dst group by all"
    steps = [f"with {TRADE}, e as materialized ({edges}), b as materialized (select u as id, v as n, weight from e union all select v, u, weight from e), l0 as (select distinct id, id as label from b)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} as materialized (select id, label from (select b.id, l.label, sum(weight) as w from b join l{k} l on l.id = b.n group by all) qualify row_number() over (partition by id order by w desc, label) = 1)")
    return ", ".join(steps) + f" select id, label from l{rounds}"


@R.query(_label_sql())
def label_propagation(spark: SparkSession, at: str) -> DataFrame:
    return G.label_propagation(G.consolidated_edges(_trade(spark, at)))


@R.query()
def louvain_communities(spark: SparkSession, at: str) -> DataFrame:
    """Modularity optimisation has no SQL form; its properties are tested instead."""
    o = table(spark, at, "orders")
    x = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    ids = x.select(F.col("src").alias("id")).union(x.select("dst")).distinct()
    return G.communities(ids, x)


@R.query()
def leiden_hierarchy(spark: SparkSession, at: str) -> DataFrame:
    """Nested communities of parts and suppliers over all order lines; tested by properties as Louvain is.

    Phases end at choices that together are worth a thousandth of modularity.
    """
    r = _trade(spark, at)
    ids = r.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.leiden_levels(ids, r, tolerance=1e-3)


@R.query(f"""with {TRADE}, e as materialized (select least(src, dst) as u, greatest(src, dst) as v, sum(case when weight <= 0 then 1 else weight end) as w from trade where src <> dst group by all),
b as (select u, v, w from e union all select v, u, w from e), k as (select right(u, 1) as c, sum(w) as k from b group by all), t as (select sum(k) as t, sum(k * k) as s from k), i as (select sum(w) as i from b where right(u, 1) = right(v, 1))
select round(i / t - s / (t * t), 9) as modularity from t, i""")
def partition_modularity(spark: SparkSession, at: str) -> DataFrame:
    """Modularity of the part and supplier graph, parted by the last digit of the number."""
    r = _trade(spark, at)
    ids = r.select(F.col("src").alias("id")).union(r.select("dst")).distinct()
    members = ids.withColumn("community", F.substring("id", -1, 1))
    return modularity(G.consolidated_edges(r), members).select(F.round("modularity", 9).alias("modularity"))


@R.query("""with t as (select p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') as w from part),
grams as (select p_partkey as query_id, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))))) as k from t),
names as (select distinct p_brand as name from part union select distinct p_name from part)
select distinct query_id, name as id from grams join names on lower(trim(name)) = k""")
def entity_link_ngrams(spark: SparkSession, at: str) -> DataFrame:
    p = table(spark, at, "part")
    names = p.select(F.col("p_brand").alias("name")).union(p.select("p_name")).distinct().select("name", F.col("name").alias("id"))
    return G.link_entities(p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")), names)


@R.query("""with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from documents), m as (select doc_id, unnest(w) as entity from w),
mine as (select distinct entity from m where doc_id = 1 and length(entity) > 6) select cast(doc_id as varchar) as id, count(distinct entity) as shared from m join mine using (entity) where doc_id <> 1 group by doc_id having count(distinct entity) >= 2""")
def blast_radius(spark: SparkSession, at: str) -> DataFrame:
    from ..functions.text import tokens

    d = table(spark, at, "documents")
    words = d.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    m = words.select("doc_id", F.explode("w").alias("id"))
    touched = m.where("doc_id = 1").where(F.length("id") > 6).select("id").distinct()
    ents = m.join(touched, "id", "left_semi").groupBy("id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("source_chunks"))
    chunks = d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("ref_doc_id"), F.lit(None).cast("timestamp").alias("valid_to"))
    return G.overlapping_chunks(ents, chunks, touched, "1", 2)


@R.query(f"with {_ENT} select distinct src, dst, type from trade where src in (select id from ents where degree >= 4) and dst in (select id from ents where degree >= 4)")
def inner_edges(spark: SparkSession, at: str) -> DataFrame:
    return G.inner_edges(_trade(spark, at), _entities(spark, at).where("degree >= 4"))
