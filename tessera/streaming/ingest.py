"""Streaming ingest: document batches into a log of versioned chunks, with cursors and tombstones.

A batch writes what it adds, closes and removes, under its own number, and a marker when it is complete;
so its cost follows the batch and not the table, and a batch that is replayed after a failure writes the
same again and makes no second version. Every so many batches the state is written whole, and what no
reader needs any more goes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_hash, estimate_tokens
from ..operators import chunking, lineage

CHUNKS = "id string, ref_doc_id string, chunk_index int, text string, source string, token_count int, hash string, created_at timestamp, valid_to timestamp, replaces string"
CLOSED = "ref_doc_id string, at timestamp, batch long"
GONE = "source string, ref_doc_id string, batch long"
#: Batches from one whole state to the next.
COMPACT_EVERY = 64


class ChunkLog:
    """The chunk table as the changes of numbered batches, under a root of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY) -> None:
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _at(self, kind: str, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, kind: str) -> list[str]:
        fs, path = self._at(kind)
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, kind: str, name: str) -> None:
        fs, path = self._at(kind, name)
        fs.mkdirs(path)

    def numbers(self) -> list[int]:
        """The complete batches that still stand as changes."""
        return [int(n) for n in self._names("done")]

    def time(self, number: int):
        """The time of a batch, fixed when it is first asked for, so that a replay has the same."""
        known = [n for n in self._names("times") if n.startswith(f"{number:010d}-")]
        if not known:
            self._mark("times", f"{number:010d}-{int(time.time() * 1000):015d}")
            known = [n for n in self._names("times") if n.startswith(f"{number:010d}-")]
        return F.timestamp_millis(F.lit(int(known[0].split("-")[1])))

    def _rows(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        at = [f"{self.root}/{kind}/{n:010d}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _state(self, before: int | None) -> DataFrame:
        """Chunks with the batch that added them, as the complete batches before a number left them."""
        bases = [int(n) for n in self._names("bases") if before is None or int(n) < before]
        base = bases[-1:]
        numbers = [n for n in self.numbers() if (not base or n > base[0]) and (before is None or n < before)]
        rows = self._rows("base", base, f"{CHUNKS}, batch long").unionByName(self._rows("added", numbers, f"{CHUNKS}, batch long"))
        ends = self._rows("closed", numbers, CLOSED).groupBy("ref_doc_id").agg(F.array_sort(F.collect_list(F.struct("batch", "at"))).alias("ends"))
        gone = self._rows("gone", numbers, GONE).groupBy("source", "ref_doc_id").agg(F.max("batch").alias("gone"))
        x = rows.join(ends, "ref_doc_id", "left").join(gone, ["source", "ref_doc_id"], "left").where("gone is null or batch > gone")
        # A chunk ends with the first closing of its document by a later batch.
        return x.withColumn("valid_to", F.coalesce("valid_to", F.get(F.filter("ends", lambda e: e["batch"] > F.col("batch")), F.lit(0))["at"])).drop("ends", "gone")

    def read(self, before: int | None = None) -> DataFrame:
        """The chunk table after all complete batches, or after those before a number."""
        x = self._state(before)
        return x.select([c for c in x.columns if c != "batch"]).select(*[c.split()[0] for c in CHUNKS.split(", ")])

    def append(self, number: int, added: DataFrame, closed: DataFrame, gone: DataFrame) -> None:
        """A batch's new chunks, the documents (ref_doc_id) that it closes and those (source, ref_doc_id) that it removes."""
        n = F.lit(number).cast("long")
        added.withColumn("batch", n).write.mode("overwrite").parquet(f"{self.root}/added/{number:010d}")
        closed.select("ref_doc_id", self.time(number).alias("at"), n.alias("batch")).write.mode("overwrite").parquet(f"{self.root}/closed/{number:010d}")
        gone.select("source", "ref_doc_id", n.alias("batch")).write.mode("overwrite").parquet(f"{self.root}/gone/{number:010d}")
        self._mark("done", f"{number:010d}")
        if number % self.compact_every == self.compact_every - 1:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Writes the state after a batch whole; removes the changes that the whole state before it has taken up."""
        earlier = [int(n) for n in self._names("bases") if int(n) < number]
        self._state(number + 1).write.mode("overwrite").parquet(f"{self.root}/base/{number:010d}")
        self._mark("bases", f"{number:010d}")
        if not earlier:
            return
        for n in [n for n in self.numbers() if n <= earlier[-1]]:
            for kind in ("done", "added", "closed", "gone"):
                fs, path = self._at(kind, f"{n:010d}")
                fs.delete(path, True)
        for n in earlier[:-1]:
            for kind in ("bases", "base"):
                fs, path = self._at(kind, f"{n:010d}")
                fs.delete(path, True)


def changed_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (id, source, kind, body, frontmatter) of a batch that are not stored as they are, with ref_doc_id and hash.

    A batch that holds a document twice keeps the one that sorts last. A document without text is changed, too:
    it closes what is stored of it and adds no chunks.
    """
    docs = documents.groupBy("id").agg(F.max_by(F.struct("updated_at", "body", "source", "kind", "frontmatter"), F.struct("updated_at", "body", "source", "kind")).alias("d")).select("id", "d.*")
    docs = docs.withColumns({"ref_doc_id": F.col("id"), "hash": document_hash(F.col("kind"), F.col("body"), F.col("frontmatter"))})
    return lineage.changed(docs, chunks.where("valid_to is null").select("ref_doc_id", "hash").distinct())


def new_chunks(changed: DataFrame, chunks: DataFrame, now, size: int = 512, overlap: int = 64) -> DataFrame:
    """The rows that changed documents add to the chunk table, as new versions."""
    parts = changed.select("ref_doc_id", "source", "hash", F.posexplode(chunking.packed_sentences(chunking.sentences(F.col("body")), size, overlap)).alias("chunk_index", "text"))
    parts = parts.withColumn("token_count", estimate_tokens(F.col("text")))
    return lineage.new_versions(chunks, parts, now)


def index_batch(documents: DataFrame, chunks: DataFrame, now, size: int = 512, overlap: int = 64) -> DataFrame:
    """The whole chunk table after a batch of documents."""
    changed = changed_documents(documents, chunks)
    return lineage.soft_close(chunks, changed, now).unionByName(new_chunks(changed, chunks, now, size, overlap)).select(chunks.columns)


def batch_writer(store: ChunkLog, tombstones: Callable[[], DataFrame] | None = None, also: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's changes go to the log; `also` gets the batch too.

    Documents (source, id) with a tombstone are not taken in, and chunks that the log has of them go.
    """

    def run(batch: DataFrame, number: int) -> None:
        docs = batch.persist()
        chunks = store.read(before=number)
        gone = chunks.select("source", "ref_doc_id").limit(0)
        if tombstones is not None:
            docs = lineage.not_tombstoned(docs, tombstones())
            removed = tombstones().select("source", F.col("id").alias("ref_doc_id")).distinct()
            gone = removed.join(chunks.select("source", "ref_doc_id"), ["source", "ref_doc_id"], "left_semi")
        changed = changed_documents(docs, chunks).persist()
        store.append(number, new_chunks(changed, chunks, store.time(number)), changed.select("ref_doc_id"), gone)
        changed.unpersist()
        if also is not None:
            also(batch, number)
        batch.unpersist()

    return run


def ingest(documents: DataFrame, store: ChunkLog, checkpoint: str, **options):
    """A streaming query of documents into the store; what there is now is one batch or more, then it ends."""
    return documents.writeStream.foreachBatch(batch_writer(store, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(messages: DataFrame, gap: str = "24 hours", late: str = "24 hours") -> DataFrame:
    """(user_id, start, end, n) of sessions over a stream of messages (user_id, ts); late ones count up to the watermark."""
    x = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return x.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sync(fetched: DataFrame, state: DataFrame, indexed: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pruned, new state) of one round of fetches.

    fetched: source, id, ..., cursor, full, error. A source with an error writes no cursor and prunes
    nothing; one that listed everything prunes what it did not list, tombstoned documents with it.
    """
    failed = fetched.where("error is not null").select("source").distinct()
    ok = fetched.join(failed, "source", "left_anti")
    documents = lineage.not_tombstoned(ok.where("id is not null"), tombstones)
    full = ok.where("full").select("source").distinct()
    pruned = indexed.join(full, "source", "left_semi").join(documents.select("source", "id"), ["source", "id"], "left_anti")
    cursors = ok.groupBy("source").agg(F.max("cursor").alias("new"))
    errors = fetched.where("error is not null").groupBy("source").agg(F.min("error").alias("last_error"))
    after = state.select("source", "cursor").join(cursors, "source", "full_outer").join(errors, "source", "full_outer")
    return documents, pruned, after.select("source", F.coalesce("new", "cursor").alias("cursor"), "last_error")
