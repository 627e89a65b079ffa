"""Retrieval as a whole and streaming ingest, with doubles for the models."""

import pytest
from pyspark.sql import functions as F

from tessera.models import HashEmbedder, ScriptedChat, embedded
from tessera.operators.filters import Filter
from tessera.operators.retrieve import Engine
from tessera.sources.readers import html_text, questions, read_tree
from tessera.streaming.ingest import ChunkLog, batch_writer, index_batch, ingest, session_stream, sync

# The gate: four documents, each of which one query is about.
DOCS = {
    "retriever": "The retriever fuses dense and lexical rank lists with reciprocal rank fusion.",
    "indexer": "The indexer splits documents into chunks and skips unchanged hashes.",
    "graphstore": "The graph store keeps entities and relations with validity windows.",
    "governance": "Governance finds duplicate files and moves them to the trash.",
}
GOLD = {"how are rank lists fused": "retriever", "what splits documents into chunks": "indexer", "where are entities and relations kept": "graphstore", "who finds duplicate files": "governance"}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(f"{d}#0", d, 0, t, "notes", f"notes/{d}.md", {"kind": "md"}, None) for d, t in DOCS.items()]
    c = spark.createDataFrame(rows, "id string, ref_doc_id string, chunk_index int, text string, source string, file_path string, metadata map<string,string>, superseded_by string")
    c = embedded(c.withColumn("valid_to", F.lit(None).cast("timestamp")), HashEmbedder(64)).cache()
    ents = spark.createDataFrame([("e1", "graph store", ["graphstore#0"]), ("e2", "indexer", ["indexer#0"])], "id string, name string, source_chunks array<string>")
    rels = spark.createDataFrame([("r1", "e1", "e2", "uses", 2.0, None, None)], "id string, src string, dst string, type string, weight double, valid_from timestamp, valid_to timestamp")
    coms = spark.createDataFrame([("c1", 0, ["e1", "e2"], "Storage of entities and chunks", "storage")], "id string, level int, members array<string>, summary string, title string")
    return Engine(c, HashEmbedder(64), ents, rels, coms, ScriptedChat(default="an answer"))


def test_regression_gate(engine):
    for q, d in GOLD.items():
        got = [r.ref_doc_id for r in Engine(engine.chunks, engine.embedder).local(q, 3).orderBy("rank").collect()]
        assert got[0] == d, (q, got)


def test_modes(engine):
    q = "graph store entities"
    local = engine.local(q).orderBy("rank").collect()
    assert local and any(r.id.startswith("community:") for r in local)
    assert all(not r.id.startswith("community:") for r in engine.local(q, spec=Filter(sources=("notes",))).collect())
    assert engine.drift(q).count() > 0 and engine.lexical_only(q).count() > 0
    assert engine.everywhere("overview") == "an answer" and engine.everywhere("overview", Filter(sources=("notes",))) is None
    best, saturated = engine.by_set("documents", ["entities", "files"])
    assert best.groupBy("ref_doc_id").count().where("count > 1").isEmpty() and saturated in (True, False)


def test_ingest_is_replayable(spark, tmp_path):
    schema = "id string, source string, kind string, body string, frontmatter map<string,string>, updated_at timestamp"
    docs = spark.createDataFrame([("a", "s", "md", "One. Two.", {}, None), ("b", "s", "md", "Three.", {}, None)], schema)
    src = str(tmp_path / "src")
    docs.write.parquet(src)
    store = ChunkLog(spark, str(tmp_path / "store"))
    q = ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"))
    q.awaitTermination()
    first = sorted((r.id, r.text) for r in store.read().collect())
    assert first == [("a#0", "One. Two."), ("b#0", "Three.")]
    changed = docs.withColumn("body", F.when(F.col("id") == "a", "One. Other.").otherwise(F.col("body")))
    now = F.lit("2024-01-01").cast("timestamp")
    once = index_batch(changed, store.read(), now)
    assert sorted(r.id for r in once.where("valid_to is null").collect()) == ["a#0#2", "b#0"]
    changed.write.mode("append").parquet(src)
    ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in store.read().collect()) == ["a#0", "a#0#2", "b#0"]
    assert [r.replaces for r in store.read().where("id = 'a#0#2'").collect()] == ["a#0"]


def test_emptied_documents_are_closed(spark, tmp_path):
    schema = "id string, source string, kind string, body string, frontmatter map<string,string>, updated_at timestamp"
    batch = lambda *rows: spark.createDataFrame([(i, "s", "md", b, {}, None) for i, b in rows], schema)
    store = ChunkLog(spark, str(tmp_path / "log"))
    run = batch_writer(store)
    active = lambda: {r.id for r in store.read().where("valid_to is null").collect()}
    run(batch(("a", "One."), ("b", "Two."), ("c", "Three."), ("d", "")), 0)
    now = F.lit("2024-01-01").cast("timestamp")
    emptied = batch(("a", ""), ("b", None), ("c", "Three."))
    assert [r.id for r in index_batch(emptied, store.read(), now).where("valid_to is null").collect()] == ["c#0"]
    run(emptied, 1)
    assert active() == {"c#0"} and store.read().count() == 3
    run(emptied, 2)
    run(batch(("a", "One.")), 3)
    assert active() == {"a#0#2", "c#0"}


def test_log_of_batches(spark, tmp_path):
    schema = "id string, source string, kind string, body string, frontmatter map<string,string>, updated_at timestamp"
    batch = lambda *rows: spark.createDataFrame([(i, "s", "md", b, {}, None) for i, b in rows], schema)
    store = ChunkLog(spark, str(tmp_path / "log"), compact_every=2)
    gone = [("s", "none")]
    run = batch_writer(store, lambda: spark.createDataFrame(gone, "source string, id string"))
    look = lambda: {r.id: r for r in store.read().collect()}
    run(batch(("a", "One."), ("b", "Two.")), 0)
    first = look()
    assert set(first) == {"a#0", "b#0"} and first["a#0"].created_at.year > 2000
    # The same batch again makes the same rows, with the same times.
    run(batch(("a", "One."), ("b", "Two.")), 0)
    assert look() == first
    run(batch(("a", "Three.")), 1)
    run(batch(("a", "Four."), ("b", "Two.")), 2)
    got = look()
    assert set(got) == {"a#0", "a#0#2", "a#0#3", "b#0"} and got["a#0#3"].valid_to is None and got["b#0"].valid_to is None
    assert got["a#0"].valid_to == got["a#0#2"].created_at and got["a#0#2"].valid_to == got["a#0#3"].created_at
    assert store.read(before=2).where("valid_to is null").count() == 2
    gone.append(("s", "b"))
    run(batch(("b", "Two.")), 3)
    assert set(look()) == {"a#0", "a#0#2", "a#0#3"}
    # A document whose tombstone was taken back comes in anew.
    gone.pop()
    for n in (4, 5):
        run(batch(("b", "Two.")), n)
    assert set(look()) == {"a#0", "a#0#2", "a#0#3", "b#0"}
    # What two whole states have taken up is removed.
    assert store.numbers() == [4, 5] and store._names("base") == ["0000000003", "0000000005"]


def test_session_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-05 00:00:00"), (2, "2024-02-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "m"))
    s = session_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "m")))
    q = s.writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.table("sess").collect()) == [(1, 1), (1, 2)]


def test_sync(spark):
    f = spark.createDataFrame([("a", "1", "c2", True, None), ("a", "2", "c2", True, None), ("b", None, "old", False, "boom")], "source string, id string, cursor string, full boolean, error string")
    state = spark.createDataFrame([("a", "c1"), ("b", "old")], "source string, cursor string")
    idx = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "5")], "source string, id string")
    docs, pruned, after = sync(f, state, idx, spark.createDataFrame([("a", "2")], "source string, id string"))
    assert [r.id for r in docs.collect()] == ["1"] and [(r.source, r.id) for r in pruned.collect()] == [("a", "9")]
    assert {r.source: (r.cursor, r.last_error) for r in after.collect()} == {"a": ("c2", None), "b": ("old", "boom")}


def test_readers(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("---\nid: a\ntitle: T\n---\n\nHello\n")
    (tmp_path / "notes" / "bad.json").write_text("{")
    (tmp_path / "q.jsonl").write_text('﻿{"question_id": "1", "question": "x", "expected_doc_ids": ["d"]}\n\n{broken\n')
    got = {r.path: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert got["notes/a.md"].body == "Hello" and got["notes/a.md"].source == "notes" and got["notes/bad.json"].error
    q = questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert sum(r._corrupt is not None for r in q) == 1 and any(r.expected_doc_ids == ["d"] for r in q)
    assert spark.sql("select '<p>a &amp; <b>b</b></p><script>x</script>' as h").select(html_text(F.col("h"))).first()[0] == "a & b"
