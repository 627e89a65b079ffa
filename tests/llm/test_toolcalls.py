import json

from pyspark.sql import functions as F

from tessera.llm.toolcalls import chat_schemas, linked, ordered, turns_as_calls, validated

CALLS = "conv_id string, call_id string, position long, tool string, arguments string, depends_on array<string>"


def calls(spark, rows):
    return spark.createDataFrame([(c, i, p, "t", a if a is None or isinstance(a, str) else json.dumps(a), d) for c, i, p, a, d in rows], CALLS).withColumns({"status": F.lit("clash"), "place": F.lit("clash")})


def order(spark, rows):
    x = ordered(calls(spark, rows).select(*[c.split()[0] for c in CALLS.split(", ")]))
    got = sorted(x.collect(), key=lambda r: (r.conv_id or "", r.order_after, r.order_depth, r.position, r.call_id or ""))
    return [(r.call_id, r.cyclic) for r in got]


def test_topological_order(spark):
    assert order(spark, [("c", "a", 0, {}, []), ("c", "b", 1, {}, ["a"])]) == [("a", False), ("b", False)]
    # A dependency that stands later lifts what needs it, and what needs that.
    rows = [("c", "a", 0, {}, ["c"]), ("c", "b", 1, {}, ["a"]), ("c", "c", 2, {}, []), ("c", "d", 3, {}, ["b", "none", "d"]), ("c", "e", 1, {}, [])]
    got = [i for i, _ in order(spark, rows)]
    assert got.index("c") < got.index("a") < got.index("b") < got.index("d") and got[0] == "e"
    cyc = dict(order(spark, [("c", "a", 0, {}, ["b"]), ("c", "b", 1, {}, ["a"]), ("c", "x", 2, {}, [])]))
    assert cyc == {"a": True, "b": True, "x": False}


def test_validation(spark):
    s = spark.sql("select * from values ('t','n','integer',true,0D,9D), ('t','s','string',false,2D,null), ('t','b','boolean',false,null,null) as s(tool, field, kind, required, least, most)")
    rows = [("c", "1", 0, {"n": 5}, []), ("c", "2", 0, {"n": "5"}, []), ("c", "3", 0, {"s": "a"}, []), ("c", "4", 0, {"n": 10, "z": 1, "b": True}, []), ("c", "5", 0, None, [])]
    got = {r.call_id: r.faults for r in validated(calls(spark, rows), s).collect()}
    assert got["1"] == [] and got["2"] == ["not a integer: n"] and set(got["3"]) == {"missing n", "out of range: s"} and set(got["4"]) == {"out of range: n", "unknown z"} and got["5"] == ["missing n"]
    assert validated(calls(spark, rows), s.limit(0)).first().faults == ["unknown tool"]


def test_nested_arguments(spark):
    s = spark.sql("""select * from values
        ('t','to','object',true,null,null,null), ('t','to.name','string',true,1D,null,null), ('t','to.age','integer',false,0D,null,null),
        ('t','tags','array',false,null,2D,null), ('t','tags[]','string',false,null,null,array('a','b')), ('t','any','object',false,null,null,null),
        ('t','parts','array',false,null,null,null), ('t','parts[]','object',false,null,null,null), ('t','parts[].n','number',true,null,null,null)
        as s(tool, field, kind, required, least, most, choices)""")
    cases = {
        '{"to":{"name":"x","age":3},"tags":["a","b"],"any":{"q":[1]},"parts":[{"n":1.5},{"n":2}]}': [],
        '{"to":{"age":1.5}}': ["missing to.name", "not a integer: to.age"],
        '{"to":{"name":"x","z":1}}': ["unknown to.z"],
        '{"to":"x"}': ["not a object: to"],
        '{"to":null}': ["not a object: to"],
        '{"to":{"name":"x"},"tags":["a","c",1]}': ["not a choice: tags[]", "not a string: tags[]", "out of range: tags"],
        '{"to":{"name":"x"},"parts":[{"n":1},{},{"n":"1"}]}': ["missing parts[].n", "not a number: parts[].n"],
        "{": ["arguments are no object"],
        "[1]": ["arguments are no object"],
        '{"to":{"name":"x"},"to":1}': ["arguments are no object"],
        "": ["arguments are no object"],
    }
    got = {r.arguments: r.faults for r in validated(calls(spark, [("c", "1", 0, a, []) for a in cases]), s).collect()}
    assert {a: sorted(f) for a, f in got.items()} == cases


def test_canonical_arguments(spark):
    long = "x y " * 300_000
    given = [' { "b" : [ 1 , {"z":true, "a":null} ], "a" : 1.50 } ', "{oops", json.dumps({"p": long}), None]
    x = calls(spark, [("c", str(k), k, a, []) for k, a in enumerate(given)])
    r = spark.createDataFrame([], "conv_id string, call_id string, position long, content string")
    got = {q.call_id: q.canonical for q in linked(x, r, chat_schemas(spark)).collect()}
    assert got["0"].startswith('{"arguments":{"a":1.5,"b":[1,{"a":null,"z":true}]},"id":"0"')
    assert json.loads(got["1"])["arguments_text"] == "{oops" and json.loads(got["2"])["arguments"]["p"] == long and "arguments" not in json.loads(got["3"])


def test_links(spark):
    x = calls(spark, [("c", "1", 0, {"b": 'q"', "a": None}, []), ("c", "2", 5, {}, ["1"]), ("c", "3", 1, {}, []), (None, "1", 0, {}, []), ("c", "1", 0, {}, [])])
    r = spark.createDataFrame([("c", "1", 1, "first"), ("c", "1", 2, "second"), ("c", "2", 3, None), ("c", "9", 4, "lost"), (None, "1", 1, "z")], "conv_id string, call_id string, position long, content string")
    s = spark.sql("select * from values ('t','b','string',false,null,null) as s(tool, field, kind, required, least, most)").selectExpr("tool", "field", "kind", "required", "cast(least as double) least", "cast(most as double) most")
    got = linked(x, r, s).collect()
    by = {(q.conv_id, q.call_id, q.status): q for q in got}
    assert len(got) == 7 and by["c", "1", "ok"].results == 2 and by["c", "2", "early"] and by["c", "3", "unanswered"] and by["c", "9", "orphan"] and by[None, "1", "unanswered"] and by[None, "1", "orphan"]
    one = next(q.canonical for q in got if q.call_id == "1" and "q" in q.canonical)
    assert json.loads(one)["content"] == "first" and list(json.loads(one)) == sorted(json.loads(one)) and " " not in one
    assert linked(x.limit(0), r.limit(0), s).count() == 0


def test_plain_turns(spark):
    t = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "assistant", "alone")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in linked(*turns_as_calls(t), chat_schemas(spark)).collect()}
    assert got["1", "1"].status == "ok" and got["1", "1"].valid and got["1", "3"].faults == "missing prompt" and got["1", "0"].status == "unanswered" and got["2", "-1"].status == "orphan"
    # The set-up waits for the last question and comes after it.
    assert (got["1", "0"].order_after, got["1", "0"].order_depth) == (3, 1) and (got["1", "3"].order_after, got["1", "3"].order_depth) == (3, 0)
