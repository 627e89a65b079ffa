import numpy as np
from pyspark.sql import functions as F

from tessera.functions import quantize as Q
from tessera.models import ScriptedChat
from tessera.operators import extract as X
from tessera.operators import views as V
from tessera.sources import sinks


def test_extraction_by_a_model(spark):
    chat = ScriptedChat([("bad", "no json"), ("Extract", '```json\n{"entities": [{"name": "A", "type": "t"}], "relations": [{"source": "A", "target": "B", "type": "uses",}]}\n```')])
    c = spark.createDataFrame([("c1", "good text"), ("c2", "bad text"), ("c3", " ")], "id string, text string")
    e, r = X.extracted(c, chat)
    assert [(x.chunk, x.name) for x in e.collect()] == [("c1", "A")] and [(x.source, x.target) for x in r.collect()] == [("A", "B")]


def test_chat_edges(spark):
    c = spark.createDataFrame([("c1", "we decided to take the blue one", ["Ann", "Bob"], "1700000000", {"bob": "1700000100"}), ("c2", "ok", ["Ann"], "1", {})], "id string, text string, speakers array<string>, ts string, speaker_ts map<string,string>")
    r = spark.createDataFrame([("c1", "bob", "plan", "decided"), ("c1", "Eve", "plan", "AGREED"), ("c1", "Ann", "x", "LIKES"), ("c2", "Ann", "y", "DECIDED")], "chunk string, source string, target string, type string")
    got = {(x.source, x.type): x.valid_from for x in X.chat_relations(c, r).collect()}
    assert set(got) == {("bob", "DECIDED"), ("Ann", "AGREED")} and got["bob", "DECIDED"] > got["Ann", "AGREED"]


def test_legal_graph(spark):
    m = spark.createDataFrame([({"code": "гк", "article_number": "17", "redactions": "[2015-03-08:42-ФЗ 2012-12-30:302-ФЗ]"},), ({"code": "гк"},)], "metadata map<string,string>")
    e, r = X.legal_graph(m)
    assert e.count() == 3
    assert [(str(x.valid_from.date()), x.valid_to and str(x.valid_to.date())) for x in r.orderBy("valid_from").collect()] == [("2012-12-30", "2015-03-08"), ("2015-03-08", None)]
    moved = X.retarget(r.limit(1), spark.createDataFrame([("a", "17"), ("b", "18"), ("c", "18")], "id string, number string"), F.lit("17"))
    assert moved.first().dst == "a"


def test_code_graph(spark):
    src = "import os\nclass A(B):\n    def m(self):\n        f()\ndef f():\n    pass\n"
    e, r = X.code_graph(spark.createDataFrame([("p/x.py", src), ("bad.py", "def (")], "path string, text string"))
    assert {(x.name, x.type) for x in e.collect()} == {("p.x", "package"), ("A", "type"), ("A.m", "method"), ("f", "function"), ("bad", "package")}
    assert {(x.source, x.target, x.type) for x in r.collect()} >= {("p.x", "os", "IMPORTS"), ("A", "B", "IMPLEMENTS"), ("A.m", "f", "CALLS"), ("A", "A.m", "DECLARES")}


def test_views(spark):
    e = spark.createDataFrame([("a", "Alpha", 2), ("b", "Beta", 1), ("c", "Gamma ray", 1)], "id string, name string, degree int")
    r = spark.createDataFrame([("r1", "a", "b", "x", ["k1"], None), ("r2", "c", "a", "x", ["k2"], None)], "id string, src string, dst string, type string, source_chunks array<string>, valid_to timestamp")
    c = spark.createDataFrame([("k1", "notes", "2024-01-01"), ("k2", "approved", "2023-01-01")], "id string, visibility string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    got = {x.neighbour: (x.nth, x.kept) for x in V.node_report("a", e, r, c, F.lit("2024-02-01").cast("timestamp"), 1).collect()}
    assert got == {"c": (1, True), "b": (2, False)}
    n, edges = V.diagram(e, r, "ALPHA")
    assert {x.id for x in n.collect()} == {"a", "b", "c"} and edges.count() == 2
    assert V.focus(e, "ray").first().id == "c"
    assert 'n0["a&quot;b"]' in V.mermaid([("1", 'a"b')], [])
    assert [x.id for x in V.inferred_edges("b", "see gamma ray and alpha", e, r).collect()] == ["c"]
    assert V.document_page(spark.createDataFrame([("p", "s", 1), ("q", "s", 2)], "path string, source string, updated_at int"), "s", 1, 1).first().path == "p"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a/b", "s", "md", "T", None, None, "Body", None, None, {"z": "1"})], "id string, source string, kind string, title string, url string, updated_at timestamp, body string, visibility string, summary string, frontmatter map<string,string>")
    sinks.tee(sinks.file_sink(str(tmp_path / "one")), sinks.file_sink(str(tmp_path / "two")))(d)
    x = spark.read.parquet(str(tmp_path / "two")).first()
    assert x.name.startswith("a_b-") and x.text == '---\nid: "a/b"\nsource: "s"\nkind: "md"\ntitle: "T"\nz: "1"\n---\n\nBody\n'
    s = spark.createDataFrame([("a",), ("b",), ("x:c",)], "id string")
    assert {r.id for r in sinks.remaining(s, s.limit(1), ["x:"]).collect()} == {"a", "b"}


def test_quantize_and_rows(spark):
    v = np.linspace(-3, 3, 64).astype("f4")
    assert np.abs(Q.dequantized(Q.quantized(v)) - v).max() < 0.02 and np.array_equal(Q.dequantized(Q.quantized(np.zeros(32))), np.zeros(32))
    t = spark.createDataFrame([(0, i, k) for i, k in enumerate([5, 7, 2, 9])], "seq int, pos int, token long")
    got = [r.rows for r in Q.token_rows(t, 2, 3, [3, 2**63 + 5, 11], [101, 103, 107, 109], [0, 101, 204, 311]).orderBy("pos").collect()]

    def brute(i, toks):
        ctx, cut = [toks[i]], False
        for s in (1, 2):
            x = toks[i - s] if i >= s and not cut else 2
            cut = cut or x == 2
            ctx.append(2 if cut else x)
        mixed, out = ctx[0] * 3, []
        for n, heads in ((2, (0, 1)), (3, (2, 3))):
            mixed ^= ctx[n - 1] * [3, 2**63 + 5, 11][n - 1]
            out += [(mixed % 2**64) % [101, 103, 107, 109][h] + [0, 101, 204, 311][h] for h in heads]
            mixed %= 2**64
        return out

    assert got == [brute(i, [5, 7, 2, 9]) for i in range(4)]
    plan, hits = Q.overlay(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "row int, seq int, value string"))
    assert {r.row: r.value for r in plan.collect()} == {1: "b", 2: "c"} and [r.row for r in hits.collect()] == [1]


def test_merges(spark):
    from tessera.functions.bpe import merges

    ranks = {("l", "o"): 0, ("lo", "w"): 1, ("e", "r"): 2}
    got = spark.createDataFrame([("lower",), ("",), (None,)], "w string").select(merges(F.col("w"), ranks).alias("p")).collect()
    assert [r.p for r in got] == [["low", "er"], [], None]
