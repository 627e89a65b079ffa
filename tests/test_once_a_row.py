"""Costly expressions stand once in the plan."""

from tessera.operators.termindex import TermIndex
from tessera.plans import evaluation


def test_words_are_found_once_a_row(spark):
    plan = evaluation.context_precision_recall(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2
    assert plan.count("array_intersect") == 1


def test_postings_are_counted_without_a_shuffle(spark):
    words = spark.createDataFrame([("1", 4, ["a", "b", "b", "c"]), ("2", 0, []), ("3", None, None), ("4", 1, ["b"])], "id string, len int, t array<string>")
    got = TermIndex._counted(words)
    assert sorted(map(tuple, got.collect())) == [("1", "a", 1, 4), ("1", "b", 2, 4), ("1", "c", 1, 4), ("4", "b", 1, 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
