"""Retrieval modes over the operators: local, lexical, drift, global and set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..models import Chat, Embedder, Reranker, asked, embedded, reranked
from . import dense, fusion, graph, lexical
from .filters import Filter, expand_collection, filter_expr
from .judge import expanded

K, CANDIDATES, ROUNDS, DRIFT_COMMUNITIES, DRIFT_SEEDS = 10, 20, 3, 3, 30


@dataclass
class Engine:
    """Tables and models of a knowledge base; entities, relations and communities may be absent.

    chunks: id, ref_doc_id, chunk_index, text, source, file_path, metadata, embedding, superseded_by,
    valid_to. communities: id, level, members, summary, title.
    """

    chunks: DataFrame
    embedder: Embedder
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    communities: DataFrame | None = None
    chat: Chat | None = None
    reranker: Reranker | None = None
    bonuses: dict[str, float] = field(default_factory=dict)
    budget: int = 0

    def _vector(self, query: str) -> list[float]:
        return self.embedder.embed([query])[0]

    def _q(self, query: str) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([(0, query)], "query_id int, query string")

    def lists(self, query: str, spec: Filter | None = None, extra: DataFrame | None = None, ablation: bool = False, candidates: int = CANDIDATES) -> DataFrame:
        """Rank lists (list, rank, id) of the legs: lexical, and unless ablated dense, graph and communities.

        The filter holds before the dense and the graph leg's limits; the lexical leg is filtered after fusion.
        """
        active = self.chunks.where(F.col("valid_to").isNull())
        out = lexical.bm25(active, self._q(query), candidates).select(F.lit("lexical").alias("list"), "rank", "id")
        if ablation:
            return out
        q = self.chunks.sparkSession.createDataFrame([(0, self._vector(query))], "query_id int, vector array<double>")
        out = out.union(dense.dense(active, q, candidates, spec).select(F.lit("dense"), "rank", "id"))
        if self.entities is not None and self.relations is not None:
            linked = graph.link_entities(self._q(query), self.entities).select("id")
            near = graph.neighbour_scores(self.relations, linked).join(linked, "id", "left_anti").orderBy(F.desc("score"), F.asc("id")).limit(graph.TOP_NEIGHBOURS)
            cited = near.join(self.entities.select("id", F.posexplode("source_chunks").alias("pos", "chunk")), "id")
            allowed = active.where(filter_expr(spec)) if spec is not None else active
            cited = cited.join(allowed.select(F.col("id").alias("chunk")), "chunk", "left_semi")
            first = cited.groupBy("chunk").agg(F.max(F.struct("score", -F.col("pos"))).alias("at")).orderBy(F.desc("at"), "chunk").limit(candidates)
            out = out.union(first.select(F.lit("graph"), F.row_number().over(Window.orderBy(F.desc("at"), "chunk")), F.col("chunk")))
            if self.communities is not None:
                best = graph.communities_for(self.communities, linked).join(self.communities.where("trim(summary) <> ''").select("id"), "id").orderBy(F.desc("hits"), "id").limit(graph.TOP_COMMUNITIES)
                out = out.union(best.select(F.lit("communities"), F.row_number().over(Window.orderBy(F.desc("hits"), "id")), F.concat(F.lit("community:"), "id")))
        return out if extra is None else out.union(extra)

    def _with_communities(self) -> DataFrame:
        """Chunks, and each community's summary as a chunk of its own document and of the source graph."""
        if self.communities is None:
            return self.chunks
        name = F.concat(F.lit("community:"), "id")
        c = self.communities.select(name.alias("id"), name.alias("ref_doc_id"), F.lit(0).alias("chunk_index"), F.col("summary").alias("text"), F.lit("graph").alias("source"), F.concat(F.lit("graph/communities/"), "id").alias("file_path"))
        return self.chunks.unionByName(c, allowMissingColumns=True)

    def _fused(self, query: str, lists: DataFrame, k: int, spec: Filter | None, cap: int = fusion.PER_DOCUMENT) -> DataFrame:
        order = (lambda x: reranked(x, query, self.reranker)) if self.reranker is not None else None
        out = fusion.fuse(lists, self._with_communities(), k, cap=cap, spec=spec, bonuses=self.bonuses, rerank=order)
        if not self.budget:
            return out.select("rank", "id", "ref_doc_id", "text", "score")
        more = fusion.expand_documents(out, self.chunks, self.budget, k)
        w = Window.orderBy("added", "rank")
        return more.join(self._with_communities().select("id", "text"), "id").select(F.row_number().over(w).alias("rank"), "id", "ref_doc_id", "text", "score")

    def local(self, query: str, k: int = K, spec: Filter | None = None) -> DataFrame:
        """(rank, id, ref_doc_id, text, score) from all legs."""
        return self._fused(query, self.lists(query, spec), k, spec)

    def lexical_only(self, query: str, k: int = K, spec: Filter | None = None) -> DataFrame:
        return self._fused(query, self.lists(query, spec, ablation=True), k, spec)

    def drift(self, query: str, k: int = K, spec: Filter | None = None) -> DataFrame:
        """Local search with one more list: chunks of the communities whose summaries are nearest the question."""
        if self.communities is None or self.entities is None:
            return self.local(query, k, spec)
        v = F.array(*[F.lit(x) for x in self._vector(query)])
        near = embedded(self.communities.where("trim(summary) <> ''").select("id", F.col("summary").alias("text"), "members"), self.embedder)
        near = near.withColumn("s", dot(F.col("embedding"), v)).where("s > 0").orderBy(F.desc("s"), "id").limit(DRIFT_COMMUNITIES)
        seeds = near.select("s", F.explode("members").alias("m")).join(self.entities.select(F.col("id").alias("m"), F.posexplode("source_chunks").alias("pos", "chunk")), "m")
        seeds = seeds.groupBy("chunk").agg(F.max(F.struct("s", -F.col("pos"))).alias("at")).orderBy(F.desc("at"), "chunk").limit(DRIFT_SEEDS)
        extra = seeds.select(F.lit("drift"), F.row_number().over(Window.orderBy(F.desc("at"), "chunk")), F.col("chunk"))
        return self._fused(query, self.lists(query, spec, extra), k, spec)

    def everywhere(self, query: str, spec: Filter | None = None) -> str | None:
        """Global mode: partial answers over the root communities' summaries, then one answer; None where it cannot be."""
        if self.communities is None or self.chat is None or (spec is not None and not spec.is_empty()):
            return None
        top = self.communities.agg(F.max("level")).first()[0]
        root = self.communities.where((F.col("level") == top) & (F.trim("summary") != "")).orderBy("id").limit(graph.ROOT_COMMUNITIES)
        prompts = root.select("id", F.concat(F.lit(query + "\n\n"), "summary").alias("prompt"))
        parts = asked(prompts, self.chat, "Answer from this summary, or say nothing.").where("trim(reply) <> ''").orderBy("id").collect()
        return self.chat.chat("Combine the partial answers.", "\n\n".join(r.reply for r in parts)) if parts else None

    def overall(self, query: str, k: int = K, spec: Filter | None = None) -> tuple[str, DataFrame]:
        """(answer, sources): global mode, and where it cannot be, an answer from a local search."""
        got = self.everywhere(query, spec)
        if got is not None:
            return got, self.chunks.limit(0).select(F.lit(0).alias("rank"), "id", "ref_doc_id", "text", F.lit(0.0).alias("score"))
        return self.naive(query, k, spec)

    def naive(self, query: str, k: int = K, spec: Filter | None = None) -> tuple[str, DataFrame]:
        """(answer, sources): a local search and one call of the model over its k texts; without a model the text is empty."""
        found = self.local(query, k, spec).persist()
        if self.chat is None:
            return "", found
        texts = [f"[{r.id}] {r.text}" for r in found.orderBy("rank").select("id", "text").collect()]
        return self.chat.chat("Answer from the context with citations.", "\n\n".join([query, *texts])), found

    def search(self, query: str, k: int = K, spec: Filter | None = None, members: DataFrame | None = None, known: DataFrame | None = None, mode: str = "local") -> tuple[str, DataFrame]:
        """(answer, sources) of a search as a user asks it, by a mode: local, lexical, drift or global.

        A source that is the name of a collection (members: collection, type, name; known: the sources
        there are) stands for all its sources.
        """
        if spec is not None and members is not None and known is not None:
            names = {c for s in spec.sources for c in ([r[0] for r in expand_collection(s, members, known).collect()] or [s])}
            spec = replace(spec, sources=tuple(sorted(names)))
        if mode == "global":
            return self.overall(query, k, spec)
        if mode == "local":
            return self.naive(query, k, spec)
        found = (self.drift if mode == "drift" else self.lexical_only)(query, k, spec).persist()
        texts = [r.text for r in found.orderBy("rank").select("text").collect()]
        return (self.chat.chat("Answer from the context with citations.", "\n\n".join([query, *texts])) if self.chat is not None else ""), found

    def by_set(self, query: str, variants: list[str] | None, spec: Filter | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
        """Set mode: the best chunk of each document over the question and its variants, and whether nothing more came.

        Rounds go on until one adds no document or the variants end, three at most. Each looks at `budget`
        candidates a leg, all chunks by default, and makes no cap by document. Summaries are no documents.
        Without variants the model is asked for them.
        """
        if variants is None:
            variants = [q for q in expanded(query, self.chat) if q != query]
        n = max(4 * CANDIDATES, self.chunks.count()) if budget is None else budget
        best, known, saturated = None, 0, False
        for k in range(ROUNDS):
            if k > len(variants) or not (q := [query, *variants][k].strip()):
                saturated = True
                break
            got = self._fused(q, self.lists(q, spec, candidates=n), n, spec, cap=n).where(~F.col("ref_doc_id").startswith("community:"))
            best = set_union(got if best is None else best.unionByName(got)).checkpoint()
            found = best.count()
            if found == known:
                saturated = True
                break
            known = found
        return best, saturated


def set_union(rows: DataFrame) -> DataFrame:
    """The best-scoring chunk of each document."""
    w = Window.partitionBy("ref_doc_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
