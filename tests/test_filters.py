from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators.filters import Filter, TimeRange, expand_collection, filter_expr, merge_and, narrow, parse_qualifiers, with_fallback


def rows(spark):
    return spark.createDataFrame(
        [(1, "a", {"lang": "en", "n": " 5 ", "t": "2024-01-02"}), (2, "b", {"lang": "de", "n": "x"}), (3, "a", None), (4, None, {"t": "2024-01-03T10:00:00Z"})],
        "id int, source string, metadata map<string,string>",
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_parts(spark):
    x = rows(spark)
    f = lambda **k: ids(x.where(filter_expr(Filter(**k))))
    assert f(sources=("a",)) == [1, 3]
    assert f(equal={"lang": "en"}) == [1]
    assert f(equal={"lang": ""}) == [3, 4]
    assert f(within={"lang": ("en", "de")}) == [1, 2]
    assert f(within={"lang": ()}) == []
    assert f(numeric=(("n", ">=", 5.0),)) == [1]
    assert f(numeric=(("n", "~", 5.0),)) == []
    assert f(time=TimeRange("t", datetime(2024, 1, 2), datetime(2024, 1, 3, 10))) == [1, 4]
    assert f(impossible=True) == []


def test_merge():
    a, b = Filter(sources=("x", "y"), equal={"k": "1"}), Filter(sources=("y", "z"), equal={"k": "2"})
    assert merge_and(a, b).sources == ("y",) and merge_and(a, b).equal == {"k": "2"}
    assert merge_and(a, Filter(sources=("q",))).impossible
    assert narrow(a, b).impossible
    assert merge_and(Filter(time=TimeRange("a")), Filter(time=TimeRange("b"))).impossible
    assert merge_and(Filter(within={"k": ("1", "2")}), Filter(within={"k": ("2", "3")})).within == {"k": ("2",)}


def test_qualifiers_and_fallback(spark):
    q = parse_qualifiers('{"equal": {"lang": " de ", "x": ""}, "time": {"field": "t", "to": "2024-01-02"}, "numeric": [{"field": "n", "op": "!", "value": 1}]}')
    assert q.equal == {"lang": "de"} and q.numeric == () and q.time.end == datetime(2024, 1, 2, 23, 59, 59, 999999)
    assert parse_qualifiers("no json") == Filter()
    x = rows(spark)
    assert ids(with_fallback(x, Filter(sources=("a",)), Filter(equal={"lang": "de"}))) == [1, 3]
    assert ids(with_fallback(x, Filter(sources=("a",)), Filter(equal={"lang": "de"}), relaxable=False)) == []


def test_collection(spark):
    members = spark.createDataFrame([("c", "chat", "*"), ("c", "wiki", "w1"), ("d", "wiki", "*")], "collection string, type string, name string")
    sources = spark.createDataFrame([("chat", "s1"), ("chat", "s2"), ("wiki", "w1"), ("wiki", "w2")], "type string, name string")
    assert sorted(r.name for r in expand_collection("c", members, sources).collect()) == ["s1", "s2", "w1"]
    assert expand_collection("none", members, sources).where(F.lit(True)).count() == 0
