"""Judges, query expansion, search modes, graph updates and budgets, with doubles for the models."""

import pytest
from pyspark.sql import functions as F

from tessera.models import HashEmbedder, ScriptedChat, embedded
from tessera.operators import evaluate, graph, history, judge, lexical
from tessera.operators.filters import Filter
from tessera.operators.retrieve import Engine

ENTITY = "id string, name string, type string, description string, source_chunks array<string>, degree long"
RELATION = "id string, src string, dst string, type string, weight double, confidence double, source_chunks array<string>, valid_from timestamp, valid_to timestamp"


class Broken:
    def chat(self, system, user):
        raise RuntimeError("down")


@pytest.mark.parametrize(
    ("reply", "want"),
    [('["a", " b ", ""]', ["a", "b"]), ('```json\n{"subqueries": ["a"]}\n```', ["a"]), ("nothing", ["q"]), ("[]", ["q"]), ('["1","2","3","4","5","6"]', list("12345")), ("[1]", ["q"])],
)
def test_expansion(reply, want):
    assert judge.expanded("q", ScriptedChat(default=reply)) == want


def test_expansion_falls_back():
    assert judge.expanded("q", None) == ["q"] and judge.expanded("q", Broken()) == ["q"] and judge.expanded(" ", ScriptedChat(default='["a"]')) == [" "]


def test_contradictions(spark):
    rows = spark.createDataFrame([(1, "when", 1, "c1", "f", "May"), (1, "when", 2, None, "f2", "June"), (2, None, 1, "c1", "f", "alone"), (3, "bad", 1, "x", "f", "p"), (3, "bad", 2, "y", "f", None)], "query_id int, query string, rank int, chunk_id string, file_name string, text string")
    found = '```json\n[{"chunk_a": " c1", "chunk_b": "f2", "reason": "dates"}, {"chunk_a": "", "chunk_b": " ", "reason": "none"}]\n```'
    chat = ScriptedChat([(r"Question: when\n\nExcerpts:\n- \[c1\] May\n- \[f2\] June$", found)], "no json")
    got = {(r.query_id, r.chunk_a, r.chunk_b, r.reason, r.failed) for r in judge.contradictions(rows, chat).collect()}
    assert got == {(1, "c1", "f2", "dates", False), (3, "", "", "", True)}
    assert judge.contradictions(rows.limit(0), chat).count() == 0


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, "q", "yes", "yes"), (2, "q", "yes", None)], "id int, question string, expected string, answer string").withColumn("prompt", judge.qa_prompt())
    chat = ScriptedChat([(r"Answer: yes", '{"passed": true, "reason": "same"}')], "?")
    assert [(r.id, r.passed, r.reason) for r in judge.verdicts(rows, chat, "Judge.").orderBy("id").collect()] == [(1, True, "same"), (2, None, None)]


def test_generated_questions_are_grounded(spark):
    rows = spark.createDataFrame([("a", "The  Store keeps\nedges."), ("b", "Other text."), ("c", None)], "id string, text string")
    chat = ScriptedChat(default='{"question": "What keeps edges?", "answer": "the store keeps edges"}')
    assert [r.id for r in judge.generated_questions(rows, chat).collect()] == ["a"]


def test_budgets_and_ladder(spark):
    stages = spark.createDataFrame([(10.0, 7), (10.0, None), (0.0, None), (None, 3), (1.0, 0), (-1.0, 5)], "seconds double, pool long")
    assert [r.affordable for r in evaluate.with_affordable(stages, 99.0).collect()] == [7, 9, 0, 0, 0, 0]
    assert [r.affordable for r in evaluate.with_affordable(stages, 0.0).collect()] == [0] * 6
    rungs = evaluate.ladder()
    assert [r[0] for r in rungs] == ["native", "hybrid", "graph", "rerank", "logic", "temporal", "qualifiers"]
    assert rungs[0][2] == frozenset() and rungs[4][1:] == ("got", rungs[3][2]) and all(a[2] <= b[2] for a, b in zip(rungs, rungs[1:], strict=False)) and "qualifier_filter" in rungs[-1][2]


def test_full_text(spark):
    c = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", "cat")], "id string, text string")
    q = spark.createDataFrame([(0, 'red" OR (fox*'), (1, "..")], "query_id int, query string")
    got = lexical.full_text(c, q, 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].score < got[1].score < 0 and lexical.full_text(c, q, 0).isEmpty()


def test_history(spark):
    cols = "id long, query string, document_ids array<string>, created_at timestamp, feedback int, feedback_at timestamp"
    h = spark.createDataFrame([(1, "a", ["d"], None, 0, None)], cols)
    h = history.recorded(h, spark.createDataFrame([(0, "c", [], None, 0, None), (0, "b", [], None, 0, None)], cols))
    assert sorted((r.id, r.query) for r in h.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    rated = history.rated(h, spark.createDataFrame([(2, 1, 5), (2, -1, 9), (7, 1, 1)], "id long, feedback int, s long").select("id", "feedback", F.timestamp_seconds("s").alias("at")))
    assert [(r.id, r.label) for r in history.labelled(rated).collect()] == [(2, "not_relevant")]


def test_document_update(spark):
    e = spark.createDataFrame([("a", "A", "t", "", ["c1"], 1), ("b", "B", "t", "", ["c1", "c9"], 1), ("z", "Z", "t", "", ["c1"], 0)], ENTITY)
    r = spark.createDataFrame([("ab", "a", "b", "x", 2.0, 0.5, ["c1", "c9"], None, None), ("az", "a", "z", "x", 1.0, 0.5, ["c1"], None, None)], RELATION)
    ne = spark.createDataFrame([("a", "A2", "", "new", ["c2"], 0, 1), ("n", "N", "t", "", ["c2"], 0, 2)], ENTITY + ", seq long")
    nr = spark.createDataFrame([("an", "a", "n", "y", 1.0, 0.9, ["c2"], None, None, 1)], RELATION + ", seq long")
    ents, rels, touched = graph.update_document(e, r, ["c1", "c2"], ne, nr)
    got = {x.id: x for x in ents.collect()}
    assert set(got) == {"a", "b", "n"} and got["a"].name == "A2" and got["a"].type == "t" and got["a"].source_chunks == ["c2"] and got["b"].source_chunks == ["c9"]
    assert {x.id: x.weight for x in rels.collect()} == {"ab": 1.0, "an": 1.0}
    assert {k: v.degree for k, v in got.items()} == {"a": 2, "b": 1, "n": 1} and sorted(x.id for x in touched.collect()) == ["a", "n"]


def test_rederived_window_holds(spark):
    t = F.timestamp_seconds
    r = spark.createDataFrame([("ab", "a", "b", "x", 1.0, 0.5, [])], "id string, src string, dst string, type string, weight double, confidence double, source_chunks array<string>").withColumns({"valid_from": t(F.lit(1)), "valid_to": t(F.lit(5))})
    new = r.withColumns({"source_chunks": F.array(F.lit("c")), "valid_from": t(F.lit(2)), "valid_to": F.lit(None).cast("timestamp"), "seq": F.lit(1)})
    e = spark.createDataFrame([("a", "", "", "", ["c"], 0), ("b", "", "", "", ["c"], 7)], ENTITY)
    ents, rels = graph.upsert_relations(e, r, new)
    got = rels.select(F.unix_seconds("valid_from").alias("f"), "valid_to", "weight").first()
    assert (got.f, got.valid_to, got.weight) == (2, None, 2.0) and {x.id: x.degree for x in ents.collect()} == {"a": 1, "b": 1}
    ents, rels = graph.delete_relations(ents, rels, rels.select("id"))
    assert rels.isEmpty() and {x.id: x.degree for x in ents.collect()} == {"a": 0, "b": 0}


def test_search_modes(spark):
    rows = [("a#0", "a", 0, "the retriever fuses lists", "notes", "a.md", {}, None), ("b#0", "b", 0, "the indexer splits text", "wiki", "b.md", {}, None)]
    c = spark.createDataFrame(rows, "id string, ref_doc_id string, chunk_index int, text string, source string, file_path string, metadata map<string,string>, superseded_by string")
    c = embedded(c.withColumn("valid_to", F.lit(None).cast("timestamp")), HashEmbedder(32)).cache()
    e = Engine(c, HashEmbedder(32), chat=ScriptedChat([(r"\[a#0\]", "from a"), ("sub-queries", '["indexer text"]')], "none"))
    assert e.naive("retriever lists", 2)[0] == "from a" and Engine(c, HashEmbedder(32)).naive("retriever")[0] == ""
    # Global mode without communities answers from a local search.
    assert e.overall("retriever lists")[0] == "from a"
    members = spark.createDataFrame([("all", "files", "wiki")], "collection string, type string, name string")
    known = spark.createDataFrame([("files", "wiki"), ("files", "notes")], "type string, name string")
    text, found = e.search("retriever lists", spec=Filter(sources=("all",)), members=members, known=known)
    assert [r.id for r in found.collect()] == ["b#0"] and text == "none"
    assert {r.ref_doc_id for r in e.by_set("retriever", None)[0].collect()} == {"a", "b"}
