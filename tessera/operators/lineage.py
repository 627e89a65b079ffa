"""Versioned chunks and documents: replacement, closing, skipping, pruning.

A table's new state is a new DataFrame made of joins; storing it is a write to a fresh path, so a batch
that is replayed after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import versioned_chunk_id


def active(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("valid_to").isNull())


def upsert(chunks: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key: incoming columns win, created_at stays, valid_to can be set but not cleared."""
    old, new = chunks.alias("old"), incoming.alias("new")
    joined = old.join(new, key, "full_outer")
    out = []
    for c in chunks.columns:
        if c == key:
            out.append(F.col(key))
        elif c == "created_at":
            out.append(F.coalesce(F.col("old.created_at"), F.col("new.created_at")).alias(c))
        elif c == "valid_to":
            out.append(F.coalesce(F.col("new.valid_to"), F.col("old.valid_to")).alias(c))
        else:
            out.append(F.when(F.col("new.created_at").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return joined.select(*out)


def soft_close(chunks: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """chunks with the active ones of docs (ref_doc_id) closed."""
    hit = docs.select("ref_doc_id").distinct().withColumn("hit", F.lit(True))
    x = chunks.join(hit, "ref_doc_id", "left")
    return x.withColumn("valid_to", F.when(F.col("hit") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).select(chunks.columns)


def new_versions(chunks: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Incoming chunks as rows of the chunk table.

    incoming: ref_doc_id, chunk_index and the content columns. A version's id is doc#index, later
    doc#index#n, and replaces names the version that it follows.
    """
    last = chunks.groupBy("ref_doc_id", "chunk_index").agg(F.max_by("id", F.struct("created_at", "id")).alias("prior"), F.count("*").alias("versions"))
    new = incoming.join(last, ["ref_doc_id", "chunk_index"], "left").withColumn("versions", F.coalesce("versions", F.lit(0)))
    new = new.withColumns({"id": versioned_chunk_id(F.col("ref_doc_id").cast("string"), F.col("chunk_index"), F.col("versions")), "replaces": F.col("prior"), "created_at": now, "valid_to": F.lit(None).cast("timestamp")})
    return new.select([c for c in chunks.columns if c in new.columns])


def replace_by_doc(chunks: DataFrame, incoming: DataFrame, now: Column, docs: DataFrame | None = None) -> DataFrame:
    """Closes the active chunks of the documents (ref_doc_id, by default those of incoming) and adds the incoming as new versions.

    A document that became empty has no incoming chunks, so docs has to name it.
    """
    replaced = incoming if docs is None else docs
    return soft_close(chunks, replaced, now).unionByName(new_versions(chunks, incoming, now), allowMissingColumns=True)


def delete_docs(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("ref_doc_id"), "ref_doc_id", "left_anti")


def forget_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """chunks, failing on the first embedding of another length."""
    ok = F.coalesce(F.col("embedding").isNull() | (F.size("embedding") == dim), F.lit(True))
    return chunks.withColumn("embedding", F.when(F.assert_true(ok, f"an embedding has not {dim} components").isNull(), F.col("embedding")))


def changed(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Documents (ref_doc_id, hash, ...) whose stored hash is another or absent; messages always."""
    known = hashes.select("ref_doc_id", "hash")
    same = documents.join(known, ["ref_doc_id", "hash"], "left_anti")
    if "kind" not in documents.columns:
        return same
    return documents.where("kind <> 'message' or kind is null").join(known, ["ref_doc_id", "hash"], "left_anti").unionByName(documents.where("kind = 'message'"))


def not_tombstoned(documents: DataFrame, tombstones: DataFrame, key: Sequence[str] = ("source", "id")) -> DataFrame:
    return documents.join(tombstones.select(*key), list(key), "left_anti")


def to_prune(indexed: DataFrame, seen: DataFrame, prefixes: Sequence[str] | None = None, key: str = "id") -> DataFrame:
    """Indexed documents that a fetch did not see; with prefixes only ids that start with one."""
    gone = indexed.join(seen.select(key), key, "left_anti")
    if prefixes is None:
        return gone
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(key).startswith(p)
    return gone.where(hit)


def reindex_garbage(indexed: DataFrame, live: DataFrame, key: str = "ref_doc_id") -> DataFrame:
    """Indexed documents that are not live, but for those fed by the interface."""
    return indexed.where("coalesce(apifed, 0) <> 1").join(live.select(key), key, "left_anti")


def version_numbers(chunks: DataFrame) -> DataFrame:
    """chunks with version: 1 for the first of each (ref_doc_id, chunk_index) in time."""
    w = Window.partitionBy("ref_doc_id", "chunk_index").orderBy("created_at", "id")
    return chunks.withColumn("version", F.row_number().over(w))


def supersede_marks(chunks: DataFrame, overlapping: DataFrame, by: Column) -> DataFrame:
    """chunks with superseded_by set for the overlapping ones (id) and cleared for those that it names."""
    hit = overlapping.select("id").distinct().withColumn("hit", F.lit(True))
    x = chunks.withColumn("superseded_by", F.when(F.col("superseded_by") == by, None).otherwise(F.col("superseded_by"))).join(hit, "id", "left")
    return x.withColumn("superseded_by", F.when(F.col("hit"), by).otherwise(F.col("superseded_by"))).select(chunks.columns)


def append_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages (run_id, order, ...) numbered on from each run's last seq."""
    last = stored.groupBy("run_id").agg(F.max("seq").alias("last"))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("order"))
    new = incoming.withColumn("nth", nth).join(last, "run_id", "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("int"))
    return stored.unionByName(new.select(stored.columns))


def interrupt_running(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): a count for each table, in one job."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
