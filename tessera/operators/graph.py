"""The entity and relation graph: merging, time, neighbourhoods, components, communities, views.

entities: id, name, type, description, source_chunks array<string>, degree, seq.
relations: id, src, dst, type, weight, valid_from, valid_to, ... and source_chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_name, query_ngrams
from ..session import ensure_checkpoint_dir, stored
from .components import components
from .modularity import LADDER, leiden

HOPS, TOP_NEIGHBOURS, TOP_COMMUNITIES, ROOT_COMMUNITIES = 2, 15, 3, 20


def _filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def _first_seen(chunks: str = "source_chunks") -> Column:
    """Distinct chunk ids of a group in the order of seq."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("seq", chunks))), lambda x: x[chunks])
    return F.array_distinct(F.flatten(lists))


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities by id in the order of seq: chunks united, the last non-empty name, type and description win."""
    last = [F.coalesce(F.max_by(c, F.when(_filled(c).isNotNull(), F.col("seq"))), F.lit("")).alias(c) for c in ("name", "type", "description")]
    return rows.groupBy("id").agg(*last, _first_seen().alias("source_chunks"), F.min_by("degree", "seq").alias("degree"))


def batch_entities(raw: DataFrame) -> DataFrame:
    """Entities of one extraction (id, name, type, description, seq): the first name, the first non-empty description."""
    return raw.groupBy("id").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.coalesce(F.min_by("description", F.when(_filled("description").isNotNull(), F.col("seq"))), F.lit("")).alias("description"))


def batch_relations(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Relations of one extraction (source, target, type) with endpoints resolved by name (name, id).

    Unknown endpoints and self-loops go, each (src, dst, type) stays once with weight 1.
    """
    n = names.select(normal_name(F.col("name")).alias("k"), F.col("id").alias("node")).groupBy("k").agg(F.min("node").alias("node"))
    x = raw.withColumns({"s": normal_name(F.col("source")), "t": normal_name(F.col("target"))})
    x = x.join(n.select(F.col("k").alias("s"), F.col("node").alias("src")), "s").join(n.select(F.col("k").alias("t"), F.col("node").alias("dst")), "t")
    return x.where("src <> dst").select("src", "dst", normal_name(F.col("type")).alias("type")).distinct().withColumn("weight", F.lit(1.0))


def merge_relations(rows: DataFrame) -> DataFrame:
    """Relations by id in the order of seq: weights add up, the first window holds, later ends close open ones.

    A stored row (seq 0) whose chunks were all taken away has no say in the window.
    """
    first = F.min_by(F.struct("valid_from", "valid_to"), F.when((F.col("seq") > 0) | (F.size("source_chunks") > 0), F.col("seq")))
    ends = F.min(F.when(F.col("seq") > 0, F.col("valid_to")))
    out = rows.groupBy("id").agg(
        F.min_by("src", "seq").alias("src"), F.min_by("dst", "seq").alias("dst"), F.min_by("type", "seq").alias("type"), F.sum("weight").alias("weight"), _first_seen().alias("source_chunks"),
        F.coalesce(F.max_by("confidence", F.when(F.col("confidence") != 0, F.col("seq"))), F.lit(0.0)).alias("confidence"), first.alias("w"), ends.alias("later"),
    )
    end = F.coalesce(F.col("w.valid_to"), F.when(F.col("w.valid_from").isNull() | (F.col("later") > F.col("w.valid_from")), F.col("later")))
    return out.select("id", "src", "dst", "type", "weight", "confidence", "source_chunks", F.col("w.valid_from").alias("valid_from"), end.alias("valid_to"))


def open_degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): open relations that touch an entity; a self-loop counts once."""
    x = relations.where(F.col("valid_to").isNull())
    ends = x.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def consolidated_edges(relations: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: parallel and reverse relations add up, a weight not above 0 counts 1, self-loops go."""
    x = relations.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("weight") <= 0, 1.0).otherwise(F.col("weight")).alias("weight"))
    return x.groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def as_of(relations: DataFrame, at: Column) -> DataFrame:
    """Relations that hold at a time; a missing end is open."""
    return relations.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def amendment_windows(amendments: DataFrame) -> DataFrame:
    """(article, law, date, valid_to): each amendment holds until the article's next date."""
    dates = amendments.select("article", "date").distinct()
    nxt = dates.withColumn("valid_to", F.lead("date").over(Window.partitionBy("article").orderBy("date")))
    return amendments.join(nxt, ["article", "date"])


def close_conflicts(relations: DataFrame) -> DataFrame:
    """relations with valid_to of an open fact set where a later fact of the same source and type has another target.

    In start order, free of the order of arrival: a fact ends at the first later start whose targets
    include another one.
    """
    starts = relations.where(F.col("valid_from").isNotNull()).groupBy("src", "type", "valid_from").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    w = Window.partitionBy("src", "type").orderBy(F.desc("valid_from")).rowsBetween(Window.unboundedPreceding, -1)
    # Of the later starts: the nearest, and for the nearest's only target the first start that has another.
    s = starts.withColumns({"next": F.min("valid_from").over(w)})
    n = s.select("src", "type", F.col("valid_from").alias("next"), F.col("lo").alias("next_lo"), F.col("hi").alias("next_hi"))
    s = s.join(n, ["src", "type", "next"], "left")
    change = Window.partitionBy("src", "type").orderBy(F.desc("valid_from"))
    differs = (F.col("next_lo") != F.col("next_hi")) | (F.col("lo") != F.col("next_lo")) | (F.col("hi") != F.col("next_hi"))
    # The end for a start whose single target goes on: that of the next start.
    s = s.withColumn("own_end", F.when(differs, F.col("next")))
    s = s.withColumn("end", F.last("own_end", ignorenulls=True).over(change.rowsBetween(Window.unboundedPreceding, 0)))
    x = relations.join(s.select("src", "type", "valid_from", "next", "next_lo", "next_hi", "end"), ["src", "type", "valid_from"], "left")
    own = F.when((F.col("next_lo") != F.col("dst")) | (F.col("next_hi") != F.col("dst")), F.col("next")).otherwise(F.col("end"))
    return x.withColumn("valid_to", F.coalesce("valid_to", own)).select(relations.columns)


def close_on_arrival(relations: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Stored relations after a batch of facts arrives: open ones of the same source and type with another target close.

    A fact with valid_from closes those that start before it, at its start; an older fact closes nothing.
    """
    new = incoming.where(F.col("valid_from").isNotNull()).select("src", "type", F.col("dst").alias("new_dst"), F.col("valid_from").alias("new_from"))
    r = relations.alias("r")
    hits = r.join(new.alias("n"), (F.col("r.src") == F.col("n.src")) & (F.col("r.type") == F.col("n.type")) & (F.col("r.dst") != F.col("n.new_dst")) & F.col("r.valid_to").isNull() & (F.col("r.valid_from").isNull() | (F.col("r.valid_from") < F.col("n.new_from"))))
    ends = hits.groupBy("r.id").agg(F.min("n.new_from").alias("end"))
    return relations.join(ends, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "end")).select(relations.columns)


def _both_ways(relations: DataFrame, *more: str) -> DataFrame:
    a = relations.select(F.col("src").alias("at"), F.col("dst").alias("to"), *more)
    return a.union(relations.select(F.col("dst").alias("at"), F.col("src").alias("to"), *more))


def neighbours(relations: DataFrame, seeds: DataFrame, hops: int = HOPS, at: Column | None = None) -> DataFrame:
    """(seed, id, hop) of what each seed (id) reaches within so many hops, itself left out.

    A join a hop; each frontier is reduced to new nodes before the next.
    """
    ensure_checkpoint_dir(relations.sparkSession)
    edges = _both_ways(as_of(relations, at) if at is not None else relations).distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, hops + 1):
        step = front.join(edges, front.id == edges["at"]).select("seed", F.col("to").alias("id")).distinct()
        front = step.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.union(front)
        if h < hops:
            seen = seen.checkpoint()
            front = seen.where(F.col("hop") == h)
    return seen.where("hop > 0")


def touched_relations(relations: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(seed, relation id, src, dst, weight): relations that an expansion of so many hops passes."""
    inner = neighbours(relations, seeds, hops - 1).select("seed", "id") if hops > 1 else None
    start = seeds.select(F.col("id").alias("seed"), "id").distinct()
    front = start.union(inner) if inner is not None else start
    ends = relations.select("id", "src", "dst", "weight", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
    r = ends.withColumnRenamed("id", "relation")
    return front.join(r, front.id == r.end).select("seed", "relation", "src", "dst", "weight").distinct()


def neighbour_scores(relations: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, score): weights of passed relations, at both ends and once a seed; reached entities only."""
    passed = touched_relations(relations, seeds, hops)
    sums = passed.select(F.col("src").alias("id"), "weight").union(passed.select(F.col("dst"), "weight")).groupBy("id").agg(F.sum("weight").alias("score"))
    reached = neighbours(relations, seeds, hops).select("id").distinct()
    return sums.join(reached, "id")


def link_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, id) of entities whose name is a window of one to four words of the query."""
    grams = queries.select("query_id", F.explode(query_ngrams(F.col("query"))).alias("k"))
    return grams.join(entities.select(normal_name(F.col("name")).alias("k"), "id"), "k").select("query_id", "id").distinct()


def overlapping_chunks(entities: DataFrame, chunks: DataFrame, touched: DataFrame, doc: str, least: int) -> DataFrame:
    """(id, shared): active chunks of other documents that share `least` touched entities or more."""
    x = entities.join(touched.select("id"), "id", "left_semi").select(F.col("id").alias("entity"), F.explode("source_chunks").alias("id"))
    met = x.join(chunks.where(F.col("valid_to").isNull() & (F.col("ref_doc_id") != doc)).select("id"), "id")
    return met.groupBy("id").agg(F.countDistinct("entity").alias("shared")).where(F.col("shared") >= least)


def orphan_communities(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """Communities none of whose members is an entity."""
    live = communities.select("id", F.explode("members").alias("m")).join(entities.select(F.col("id").alias("m")), "m", "left_semi").select("id").distinct()
    return communities.join(live, "id", "left_anti")


def communities_for(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hits): communities with any of the ids, by how many."""
    m = communities.select("id", F.explode("members").alias("m"))
    return m.join(ids.select(F.col("id").alias("m")).distinct(), "m").groupBy("id").agg(F.count("*").alias("hits"))


def community_chunks(members: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(community, chunks): sorted distinct chunks of members (community, id) and of their inner relations."""
    own = members.join(entities.select("id", F.explode("source_chunks").alias("chunk")), "id").select("community", "chunk")
    s, d = members.select(F.col("id").alias("src"), F.col("community").alias("a")), members.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    inner = relations.join(s, "src").join(d, "dst").where("a = b").select(F.col("a").alias("community"), F.explode("source_chunks").alias("chunk"))
    return own.union(inner).groupBy("community").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"))


def connected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, component): every entity with the smallest entity it is connected to; closed relations count too."""
    found = components(relations.select("src", "dst"), "src", "dst")
    return entities.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label) after at most so many synchronous rounds over consolidated edges (u, v, weight).

    A node takes the label of most weight among its neighbours, ties by smallest label. Where a round gives
    every node the label that it had two rounds before, all further rounds are known, and so is the last.
    """
    both = stored(edges.select(F.col("u").alias("id"), F.col("v").alias("by"), "weight").union(edges.select("v", "u", "weight")))
    now = stored(both.select("id").distinct().select("id", F.col("id").alias("label"), F.lit(None).cast(both.schema["id"].dataType).alias("before")))
    for done in range(1, rounds + 1):
        votes = both.join(now.select(F.col("id").alias("by"), "label"), "by").groupBy("id", "label").agg(F.sum("weight").alias("w"))
        order = [F.desc("w"), F.asc("label")]
        best = votes.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("nth = 1").select("id", F.col("label").alias("next"))
        now = stored(now.join(best, "id").select("id", F.col("next").alias("label"), F.col("label").alias("before"), (F.col("next") != F.col("label")).alias("moved"), (~F.col("next").eqNullSafe(F.col("before"))).alias("new")))
        moved, new = now.agg(F.bool_or("moved"), F.bool_or("new")).first()
        if not new:
            return now.select("id", F.col("before" if (rounds - done) % 2 else "label").alias("label"))
        if not moved:
            break
    return now.select("id", "label")


def communities(entities: DataFrame, relations: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(id, community) by modularity, as Louvain has it; an entity without edges is a community of its own."""
    return leiden(entities, consolidated_edges(relations), (1.0,), tolerance, refine=False).select("id", "community")


def leiden_levels(entities: DataFrame, relations: DataFrame, resolutions: tuple[float, ...] = LADDER, tolerance: float = 0.0) -> DataFrame:
    """(level, id, community): nested communities from fine to coarse, each connected; see `modularity.leiden`."""
    return leiden(entities, consolidated_edges(relations), resolutions, tolerance)


def remove_chunks(rows: DataFrame, gone: list[str]) -> DataFrame:
    """Entities or relations without those chunks; a relation's weight becomes the number that is left."""
    left = F.array_except("source_chunks", F.array(*[F.lit(g) for g in gone]))
    changed = {"source_chunks": left}
    if "weight" in rows.columns:
        changed["weight"] = F.when(F.size(left) < F.size("source_chunks"), F.size(left).cast("double")).otherwise(F.col("weight"))
    return rows.withColumns(changed)


def prune_orphans(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("source_chunks") > 0)


def recounted(entities: DataFrame, relations: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """entities with the degrees of the touched ones (id), or of all, counted anew over open, supported relations."""
    r = relations.where(F.size("source_chunks") > 0) if "source_chunks" in relations.columns else relations
    x = entities.join(open_degrees(r).withColumnRenamed("degree", "open"), "id", "left")
    hit = F.lit(True)
    if touched is not None:
        x, hit = x.join(touched.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left"), F.col("hit")
    return x.withColumn("degree", F.when(hit, F.coalesce("open", F.lit(0))).otherwise(F.col("degree"))).select(entities.columns)


def _ends(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _put(stored: DataFrame, incoming: DataFrame, kept: dict[str, Column]) -> DataFrame:
    """stored with the incoming rows in the place of those of the same id; `kept` says what a column takes over."""
    old, new = stored.alias("old"), incoming.withColumn("incoming", F.lit(True)).alias("new")
    x = old.join(new, "id", "full_outer")
    got = F.col("new.incoming")
    return x.select("id", *[F.when(got, kept.get(c, F.col(f"new.{c}"))).otherwise(F.col(f"old.{c}")).alias(c) for c in stored.columns if c != "id"]).select(stored.columns)


def put_entities(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """entities with incoming ones written over those of the same id; a degree of 0 takes the stored one."""
    degree = F.when(F.coalesce(F.col("new.degree"), F.lit(0)) == 0, F.coalesce(F.col("old.degree"), F.lit(0))).otherwise(F.col("new.degree"))
    return _put(entities, incoming, {"degree": degree})


def put_relations(entities: DataFrame, relations: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with incoming relations written over those of the same id, degrees of their ends counted anew.

    A missing start, end or confidence stays as stored; `reopen` clears the end.
    """
    kept = {
        "valid_from": F.coalesce("new.valid_from", "old.valid_from"),
        "valid_to": F.when(~F.coalesce(F.col("new.reopen"), F.lit(False)), F.coalesce("new.valid_to", "old.valid_to")),
        "confidence": F.when(F.coalesce(F.col("new.confidence"), F.lit(0.0)) == 0, F.coalesce(F.col("old.confidence"), F.lit(0.0))).otherwise(F.col("new.confidence")),
    }
    after = _put(relations, incoming, kept)
    every = recounted(entities, after.drop("source_chunks"), _ends(incoming))
    return every, after


def upsert_relations(entities: DataFrame, relations: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch of extracted relations: conflicts close, relations merge, degrees of their ends are counted anew.

    incoming: the columns of relations and seq, from 1 in the order of arrival. An open stored fact ends where
    an incoming one of its source and type starts later with another target.
    """
    columns = relations.columns
    closed = close_on_arrival(relations, incoming, F.current_timestamp()).withColumn("seq", F.lit(0))
    touched_ids = incoming.select("id").distinct()
    rest = closed.join(touched_ids, "id", "left_anti").drop("seq")
    both = closed.join(touched_ids, "id", "left_semi").unionByName(incoming.select(*columns, "seq"))
    after = rest.unionByName(merge_relations(both).select(columns))
    every = recounted(entities, after.drop("source_chunks"), _ends(incoming))
    return every, after


def update_document(entities: DataFrame, relations: DataFrame, gone: list[str], new_entities: DataFrame, new_relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, touched ids) after a document was extracted again.

    gone: the ids of its old and new chunks, whose contribution goes first; then what was extracted is
    merged, what has no chunk left is pruned, and degrees are counted anew. touched holds the entities that
    the new chunks name. new_entities and new_relations have seq, from 1. A relation that loses an end
    goes with it.
    """
    left_e, left_r = remove_chunks(entities, gone), remove_chunks(relations, gone)
    e = merge_entities(left_e.withColumn("seq", F.lit(0)).unionByName(new_entities.select(*entities.columns, "seq"))).select(entities.columns)
    e, r = upsert_relations(e, left_r, new_relations)
    e = prune_orphans(e)
    alive = e.select("id")
    r = prune_orphans(r).join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi").select(relations.columns)
    return recounted(e, r), r, new_entities.select("id").union(_ends(new_relations)).distinct()


def delete_entities(entities: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids and what touches them, degrees counted anew."""
    gone = ids.select("id").distinct()
    r = relations.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    e = entities.join(gone, "id", "left_anti").drop("degree").join(open_degrees(r), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return e, r


def delete_relations(entities: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without those relations, degrees of their ends counted anew."""
    r = relations.join(ids.select("id"), "id", "left_anti")
    e = recounted(entities, r.drop("source_chunks"), _ends(relations.join(ids.select("id"), "id", "left_semi")))
    return e, r


def filtered_view(entities: DataFrame, relations: DataFrame, *, kind: str | None = None, least_degree: int = 0, text: str = "", limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the entities of most degree that pass, 1000 at most, and the relations among them."""
    x = entities.where(F.col("degree") >= least_degree)
    if kind:
        x = x.where(F.col("type") == kind)
    if text:
        x = x.where(F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower()))
    nodes = x.orderBy(F.desc("degree"), "name", "id").limit(min(limit, 1000))
    ids = nodes.select("id")
    edges = relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges


def edge_groups(relations: DataFrame, node: Column, limit: int) -> DataFrame:
    """(type, neighbour, created_at, nth, total): a node's relations by type, newest first, `limit` of each type."""
    x = relations.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("neighbour", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))
    w = Window.partitionBy("type")
    x = x.withColumns({"nth": F.row_number().over(w.orderBy(F.desc("valid_from"), "neighbour", "id")), "total": F.count("*").over(w)})
    return x.where(F.col("nth") <= limit).select("type", "neighbour", F.col("valid_from"), "nth", "total")


def inner_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type) once each: unexpired relations with both ends among the nodes, without self-loops."""
    ids = nodes.select("id").distinct()
    x = relations.where("src <> dst and valid_to is null")
    x = x.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return x.select("src", "dst", "type").distinct()


def replace_relation(relations: DataFrame, old: str, new: DataFrame) -> DataFrame:
    """relations with one edge moved to a new id (one row), merged into what stands there."""
    moved = relations.where(F.col("id") == old).drop("id", "src", "dst", "type").crossJoin(F.broadcast(new.select("id", "src", "dst", "type")))
    rest = relations.where(F.col("id") != old)
    both = rest.withColumn("seq", F.lit(0)).unionByName(moved.withColumn("seq", F.lit(1)))
    return merge_relations(both)
