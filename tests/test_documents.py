import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import phrases as P
from tessera.functions import text as X
from tessera.functions.stems import english, russian
from tessera.operators import ask, chunking, dedup, evaluate, graph, lineage
from tessera.sources import parse
from tessera.sources.connectors import SERVICES, Pager, fetch, fetch_many


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in cols.items()))
    return df.select(c.alias("x")).first().x


def test_text_functions(spark):
    a = F.col("a")
    assert one(spark, X.normalized_stem(a), a="n/My Doc_2024-01-02 copy.md") == "my-doc"
    assert one(spark, X.sanitize_id(a), a="..") == "_"
    assert one(spark, X.sanitize_id(a), a="a/b").startswith("a_b-")
    assert one(spark, X.fallback_summary(a), a=" One two.\nThree. ") == "One two."
    assert one(spark, X.redact_pii(a), a="x@y.org 123-45-6789") == "<email> <ssn>"
    assert one(spark, X.leak_reasons(a), a="mail x@y.org at 10.0.0.1") == ["email", "ipv4"]
    assert one(spark, X.leak_reasons(a, {"deny_term": ["Secret"]}), a="the secret") == ["deny_term"]
    assert one(spark, X.leak_reasons(a), a=" ") == ["empty_query"]
    assert one(spark, X.is_small_talk(a), a="thanks") and not one(spark, X.is_small_talk(a), a="a message of some length")
    assert one(spark, X.chat_time(a), a="1700000000") == one(spark, X.chat_time(a), a="1700000000000")
    assert one(spark, X.chat_time(a), a="nonsense") is None
    assert one(spark, X.roman_number(a), a="XIV") == 14
    assert [(str(r.date), r.law) for r in one(spark, X.amendments(a), a="[2012-12-30:302-ФЗ bad 2012-12-30:302-ФЗ]")] == [("2012-12-30", "302-ФЗ")]
    assert one(spark, X.strip_code_fence(a), a='```json\n{"a": [1,],}\n```') == '{"a": [1]}'
    assert one(spark, X.recency(F.col("a")), a=7200) == "2h"
    assert one(spark, X.query_ngrams(a), a="Big Red dog") == ["big", "red", "dog", "big red", "big.red", "red dog", "red.dog", "big red dog", "big.red.dog"]


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("generously", "generous"), ("happily", "happili"), ("hopping", "hop"), ("flies", "fli"), ("dying", "die"), ("agreed", "agre")])
def test_english_stems(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("важный", "важн"), ("важная", "важн"), ("красота", "красот"), ("возможность", "возможн"), ("документы", "документ"), ("документов", "документ")])
def test_russian_stems(word, stem):
    assert russian(word) == stem


def test_phrases(spark):
    t = X.tokens
    a, b = F.col("a"), F.col("b")
    at = lambda x, y: one(spark, P.phrase_at(t(a), t(b), t(a)), a=x, b=y)
    assert at("the timeout is 30 seconds", "30 seconds")
    assert not at("the timeout is not 30 seconds", "30 seconds")
    assert not at("", "x") and not at("x", "")
    assert one(spark, P.fact_covered(a, b), a="The cache holds 20 entries", b="cache holds 20 entries")
    assert not one(spark, P.fact_covered(a, b), a="The cache never holds 20 entries", b="cache holds 20 entries")


def test_lineage(spark):
    c = spark.createDataFrame([("d#0", "d", 0, "old", datetime(2024, 1, 1), None, None)], "id string, ref_doc_id string, chunk_index int, text string, created_at timestamp, valid_to timestamp, replaces string")
    new = spark.createDataFrame([("d", 0, "new"), ("d", 1, "more")], "ref_doc_id string, chunk_index int, text string")
    got = {r.id: r for r in lineage.replace_by_doc(c, new, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert set(got) == {"d#0", "d#0#2", "d#1"} and got["d#0"].valid_to and got["d#0#2"].replaces == "d#0" and got["d#1"].replaces is None
    up = lineage.upsert(c, c.withColumns({"text": F.lit("x"), "created_at": F.lit("2025-01-01").cast("timestamp"), "valid_to": F.lit("2025-01-01").cast("timestamp")}))
    assert up.first().text == "x" and up.first().created_at == datetime(2024, 1, 1) and lineage.upsert(up, c).first().valid_to is not None


def test_sentence_packing(spark):
    texts = ["One two three. Four five six seven. Eight nine ten eleven twelve! Thirteen fourteen.", "", "Word"]

    def loop(t, size, overlap):
        import re

        est = lambda s: max(1, len(s) // 4) if s else 0
        sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]
        out, cur = [], []
        for s in sents:
            if cur and sum(map(est, cur)) + est(s) > size:
                out.append(" ".join(cur))
                keep, n = [], 0
                for p in reversed(cur) if overlap else ():
                    keep.insert(0, p)
                    n += est(p)
                    if n >= overlap:
                        break
                cur = keep
            cur.append(s)
        return out + ([" ".join(cur)] if cur else [])

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for size, overlap in ((6, 0), (10, 4), (100, 8)):
        got = {i: [] for i in range(3)}
        for r in chunking.text_chunks(df, "id", "t", size, overlap).orderBy("id", "chunk_index").collect():
            got[r.id].append(r.text)
        assert got == {i: loop(t, size, overlap) for i, t in enumerate(texts)}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é1_. ", max_size=60))
def test_simhash_is_fnv_over_shingles(text):
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    bits = [0] * 64
    for s in shingles:
        h = 14695981039346656037
        for b in s.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        for k in range(64):
            bits[k] += 1 if h >> k & 1 else -1
    value = sum(1 << k for k in range(64) if bits[k] > 0)
    assert dedup.simhash_of(text) == (value - 2**64 if value >> 63 else value, len(words))


def test_duplicates(spark):
    prints = spark.createDataFrame([(1, "s", 0), (2, "s", 7), (3, "s", 63), (4, "t", 0), (5, "s", 0)], "id long, source string, fp long")
    for most in (3, 12):
        pairs = {(r.a, r.b): r.distance for r in dedup.near_pairs(prints, most).collect()}
        assert pairs == {k: d for k, d in {(1, 2): 3, (2, 5): 3, (1, 5): 0, (2, 3): 3, (1, 3): 6, (3, 5): 6}.items() if d <= most}
    led = {r.id: r.duplicate_of for r in dedup.leaders(dedup.near_pairs(prints, 3), prints.select("id")).collect()}
    assert led == {1: None, 2: 1, 3: None, 4: None, 5: 1}


def test_graph_properties(spark):
    e = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1), (5, 5, 1.0), (6, 5, -1.0)]
    r = spark.createDataFrame(edges, "src long, dst long, weight double")
    comp = {x.id: x.component for x in graph.connected(e, r).collect()}
    assert comp == {**dict.fromkeys(range(7), 0), 7: 7}
    com = {x.id: x.community for x in graph.communities(e, r).collect()}
    assert com[0] == com[1] == com[2] != com[3] == com[4] == com[5] and com[7] == 7
    lab = {x.id: x.label for x in graph.label_propagation(graph.consolidated_edges(r)).collect()}
    assert set(lab) == set(range(7)) and all(comp[a] == comp[b] for a in lab for b in lab if lab[a] == lab[b])
    assert graph.connected(e.limit(0), r.limit(0)).count() == 0
    tree = [(x.level, x.id, x.community) for x in graph.leiden_levels(e, r).collect()]
    assert tree and all(comp[i] == comp[c] for _, i, c in tree)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.lists(st.sampled_from("abcdefx"), max_size=4)))
def test_question_order(deps):
    ids = sorted(deps)
    clean = ask.clean_dependencies(ids, deps)
    at = ask.levels(ids, deps)
    assert all(at[d] < at[i] for i in ids for d in clean[i])
    assert [i for w in ask.waves(ids, deps) for i in w] == sorted(ids, key=lambda i: (at[i], i))


def test_ask():
    from tessera.models import ScriptedChat

    chat = ScriptedChat([("Decompose", '[{"query": "how does a work"}, {"query": "list all b", "depends_on": ["0", "9"]}]'), ("Answer", "text (c1)"), ("Combine", "whole")])
    got = ask.ask("q", lambda q, m: [("c1", "context", 0.9)] * 8, chat)
    assert got.text == "whole" and [n.mode for n in got.nodes] == ["local", "set"] and got.nodes[1].depends_on == ["0"] and not got.abstained
    assert ask.ask("q", lambda q, m: [], ScriptedChat()).abstained


def test_parsers(tmp_path):
    known, rest, body = parse.frontmatter('---\nid: x1\ntitle: "A: b"\nupdated_at: 2024-01-02T03:04:05Z\ntags:\n- a\n- b\n---\n\nBody\n')
    assert known["title"] == "A: b" and rest == {"tags": "a b"} and body == "Body\n"
    assert parse.frontmatter(parse.render({"id": "x", "z": "1"}, " b "))[0] == {"id": "x"}
    with pytest.raises(ValueError):
        parse.frontmatter("---\nupdated_at: soon\n---\n")
    assert parse.flat_json('{"a": {"b": [1, null]}, "c": "x"}') == "- `$.a.b[0]`: 1\n- `$.a.b[1]`: null\n- `$.c`: x"
    tables = dict(parse.ddl_tables("-- c\ncreate table a (id int primary key, n text default ';');\nCREATE TABLE b (x int, foreign key (x) references a(id));"))
    assert "Primary key: id" in tables["a"] and "x -> a(id)" in tables["b"]
    title, md = parse.html_markdown("<html><head><title>T</title><script>x</script></head><body><h2>Hi</h2><p>a <a href='/b'>link</a></p><ul><li>1<li>2</ul></body></html>", "http://h/x")
    assert title == "T" and "## Hi" in md and "[link](http://h/b)" in md and "- 1" in md and "x</" not in md
    laws = parse.law_articles("# [гк-рф] Кодекс\n## Часть первая\n## Раздел II. О\n### Глава 3. Г\n### Статья 17. Право\nТекст (в ред. Федерального закона от 30.12.2012 N 302-ФЗ).\n")
    assert laws[0]["id"] == "гк-рф/ч1/р2/гл3/ст17" and laws[0]["amendments"] == "2012-12-30:302-ФЗ"
    assert parse.feed_items("<rss><channel><item><guid>1</guid><title>t</title><description>&lt;p&gt;b&lt;/p&gt;</description></item></channel></rss>")[0]["body"] == "b"
    p = tmp_path / "x.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>a|b</t></is></c></row><row><c r="B2"><v>2</v></c></row></sheetData></worksheet>')
    assert parse.xlsx_sheets(p.read_bytes()) == [("S", "| a\\|b |  |\n| --- | --- |\n|  | 2 |")]


def test_connectors(spark):
    pages = {"https://api.github.com/repos/o/r/issues": ({"Link": '<http://p2>; rel="next"'}, '[{"number": 1, "title": "a", "updated_at": "2024-01-01T00:00:00Z", "body": "x"}]'), "http://p2": ({}, '[{"number": 2, "title": "b", "updated_at": "2024-01-02T00:00:00Z", "body": null}]')}
    got = fetch(SERVICES["github"], lambda u, p: pages[u], {"repo": "o/r"})
    assert [d["id"] for d in got.documents] == ["1", "2"] and got.cursor == "2024-01-02T00:00:00Z" and got.full
    seen = []
    again = fetch(SERVICES["github"], lambda u, p: (seen.append(p), ({}, "[]"))[1], {"repo": "o/r"}, got.cursor)
    assert not again.full and seen[0]["since"] == "2024-01-01T23:59:59+00:00" and again.cursor == got.cursor
    assert Pager("offset", "o", "n", 10).following("u", {"o": "10"}, {}, {"n": 25}) == ("u", {"o": "20"})
    assert Pager("cursor", "c", "m.c").following("u", {}, {}, {"m": {"c": ""}}) is None

    def recorded(url, params):
        if "none" in url:
            raise OSError("no such repository")
        return {}, '[{"number": 1, "title": "a", "updated_at": "2024-01-01T00:00:00Z", "body": "x"}]'

    rows = fetch_many(spark, [("one", "github", {"repo": "o/r"}, ""), ("two", "github", {"repo": "none"}, "old")], recorded).collect()
    assert sorted((r.source, r.id, r.error is None) for r in rows) == [("one", "1", True), ("two", None, False)]
    assert next(r for r in rows if r.source == "two").cursor == "old"


def test_evaluation_edges(spark):
    s = spark.createDataFrame([(False, "stale", "current"), (False, "missing", "stale"), (True, "current", "current")], "control boolean, before string, after string")
    r = evaluate.dcs_report(s).first()
    assert (r.currency, r.adoption, r.stability) == (0.5, 1.0, 1.0) and r.dcs == 1.0
    assert evaluate.dcs_report(s.limit(0)).first().affected == 0
