"""Views of documents and of the graph for readers: pages, a node's report, diagrams, tool answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import authority_rank, normal_name
from . import graph


def document_page(docs: DataFrame, source: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of documents (path, source, updated_at), newest first, 200 at most."""
    x = docs.where(F.col("source") == source) if source else docs
    return x.orderBy(F.desc("updated_at"), "path").offset(offset).limit(min(limit, 200))


def real_documents(ids: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose id names a document, not a summary that the engine made."""
    x = F.col(col)
    return ids.where((x != "set-summary") & ~x.startswith("global:") & ~x.startswith("community:"))


def document_relations(rows: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """Entities or relations that have a source chunk of the document."""
    own = chunks.where(F.col("ref_doc_id") == doc).select(F.col("id").alias("chunk"))
    hit = rows.select("id", F.explode("source_chunks").alias("chunk")).join(own, "chunk", "left_semi").select("id").distinct()
    return rows.join(hit, "id", "left_semi")


def node_report(entity: str, entities: DataFrame, relations: DataFrame, chunks: DataFrame, now: Column, limit: int) -> DataFrame:
    """(type, neighbour, nth, kept): a node's neighbours by relation type, best first; those past the limit are not kept.

    Best is the smallest authority rank among a relation's chunks, then the newest chunk, then the id.
    chunks: id, visibility, created_at.
    """
    x = relations.where(((F.col("src") == entity) | (F.col("dst") == entity)) & (F.col("src") != F.col("dst")))
    x = x.withColumn("neighbour", F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src"))).join(entities.select(F.col("id").alias("neighbour")), "neighbour", "left_semi")
    c = chunks.select(F.col("id").alias("chunk"), authority_rank(F.col("visibility")).alias("rank"), (F.unix_seconds(now) - F.unix_seconds("created_at")).alias("age"))
    s = x.select("id", F.explode_outer("source_chunks").alias("chunk")).join(c, "chunk", "left").groupBy("id").agg(F.coalesce(F.min("rank"), F.lit(2)).alias("rank"), F.coalesce(F.min("age"), F.lit(2**62)).alias("age"))
    w = Window.partitionBy("type").orderBy("rank", "age", "neighbour", "id")
    return x.join(s, "id").withColumn("nth", F.row_number().over(w)).select("type", "neighbour", "nth", (F.col("nth") <= limit).alias("kept"))


def focus(entities: DataFrame, text: str) -> DataFrame:
    """The one entity that a text means: by name, by id, else the one of most degree whose name has it."""
    t = text.strip().lower()
    order = F.when(normal_name(F.col("name")) == t, 0).when(F.col("id") == text.strip(), 1).when(F.lower("name").contains(t), 2)
    return entities.withColumn("how", order).where("how is not null").orderBy("how", F.desc("degree"), "name", "id").limit(1).drop("how")


def diagram(entities: DataFrame, relations: DataFrame, text: str, hops: int = 1, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a focus: within three hops at most, the focus and those of most degree, 60 at most."""
    at = focus(entities, text)
    reached = graph.neighbours(relations, at.select("id"), min(hops, 3)).select("id").distinct()
    first = at.withColumn("first", F.lit(0))
    near = entities.join(reached, "id", "left_semi").withColumn("first", F.lit(1))
    nodes = first.unionByName(near).orderBy("first", F.desc("degree"), "name", "id").limit(min(most, 60)).drop("first")
    return nodes, graph.inner_edges(relations, nodes)


def mermaid(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> str:
    """A flow chart of (id, name) and (src, dst, type); labels cannot break out of their quotes."""
    clean = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", " ")
    at = {i: f"n{k}" for k, (i, _) in enumerate(nodes)}
    return "\n".join(["flowchart LR", *(f'  {at[i]}["{clean(n)}"]' for i, n in nodes), *(f'  {at[a]} -->|"{clean(t)}"| {at[b]}' for a, b, t in edges if a in at and b in at)])


def graph_query(text: str, entities: DataFrame, relations: DataFrame, communities: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, neighbours, communities) of the entities that a text names, each once."""
    q = entities.sparkSession.createDataFrame([(0, text)], "query_id int, query string")
    hit = entities.join(graph.link_entities(q, entities).select("id"), "id", "left_semi")
    near = entities.join(graph.neighbours(relations, hit.select("id"), hops).select("id").distinct(), "id", "left_semi").join(hit.select("id"), "id", "left_anti")
    return hit, near, communities.join(graph.communities_for(communities, hit.select("id")).select("id"), "id", "left_semi")


def inferred_edges(node: str, text: str, entities: DataFrame, relations: DataFrame, limit: int = 10) -> DataFrame:
    """Entities that a node's own text names and that it has no relation to."""
    q = entities.sparkSession.createDataFrame([(0, text)], "query_id int, query string")
    known = graph.neighbours(relations, entities.where(F.col("id") == node).select("id"), 1).select("id")
    return graph.link_entities(q, entities).select("id").where(F.col("id") != node).join(known, "id", "left_anti").orderBy("id").limit(limit)


def stale_communities(communities: DataFrame, components: DataFrame, touched: DataFrame) -> DataFrame:
    """communities with stale set where a member's component was touched; components: id, component."""
    hit = components.join(touched.select("id"), "id", "left_semi").select("component").distinct()
    members = communities.select("id", F.explode("members").alias("m")).join(components.select(F.col("id").alias("m"), "component"), "m").join(hit, "component", "left_semi").select("id").distinct().withColumn("now", F.lit(True))
    return communities.join(members, "id", "left").withColumn("stale", F.col("stale") | F.coalesce("now", F.lit(False))).drop("now")


def refreshed(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """New communities (id, level, members) with the summaries that communities of the same id had; orphans go."""
    kept = new.join(old.select("id", "summary", "title"), "id", "left").withColumn("stale", F.lit(False))
    return kept.join(graph.orphan_communities(kept, entities).select("id"), "id", "left_anti")
