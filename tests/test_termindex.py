"""The kept index against BM25 over the texts that there are, after batches, deletions, replays and merges."""

import random

from pyspark.sql import functions as F

from tessera.operators.lexical import bm25
from tessera.operators.termindex import TermIndex
from tessera.plans import search

WORDS = [f"word{i}" for i in range(30)]


def test_index_equals_bm25_after_batches(spark, tmp_path):
    rng = random.Random(3)
    index, now = TermIndex(spark, str(tmp_path / "index"), buckets=16), {}
    queries = spark.createDataFrame([(1, "word1 word2 word2"), (2, "word7 nowhere"), (3, "")], "query_id int, query string")
    texts = lambda rows: spark.createDataFrame(list(rows.items()), "id string, text string")

    def check():
        told = lambda x: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in x.collect())
        assert told(index.search(queries, 10)) == told(bm25(texts(now), queries, 10))

    for number in range(3):
        batch = {str(rng.randrange(40)): rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))]) if i else "word1 word2" for i in range(20)}
        gone = {str(rng.randrange(40)) for _ in range(5)}
        index.add(number, texts(batch), spark.createDataFrame([(g,) for g in gone], "id string"))
        now = {k: v for k, v in now.items() if k not in gone} | batch
        check()
    # The same batch again changes nothing; a batch without its mark is none.
    index.add(2, texts(batch), spark.createDataFrame([(g,) for g in gone], "id string"))
    check()
    index.merge()
    check()
    index.clean()
    assert index.segments() == [(0, 2)]
    check()
    index.add(3, texts({"0": "word1"}), spark.createDataFrame([("1",)], "id string"))
    now = {k: v for k, v in now.items() if k != "1"} | {"0": "word1"}
    check()


def test_queries_read_their_buckets_only(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "index"), buckets=16)
    assert index.search(spark.createDataFrame([(1, "word1")], "query_id int, query string"), 5).count() == 0
    index.add(0, spark.createDataFrame([(str(i), " ".join(WORDS)) for i in range(9)], "id string, text string"))
    found = index.postings(["word1"])
    assert found.count() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_query_equals_bm25_of_what_is_left(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id % 5 <> 1 or doc_id % 4 = 0")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(f" {search.WORDS}"))).otherwise(F.col("text"))
    left = docs.select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    want = bm25(left, spark.createDataFrame([(0, search.WORDS)], "query_id int, query string"), 20)
    told = lambda x: sorted((r["rank"], r.id, round(r.score, 6)) for r in x.collect())
    assert told(search.kept_index_topk(spark, at)) == told(want) and want.count() == 20
