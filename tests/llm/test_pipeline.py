"""The pipeline over the smallest tables, a stage at a time, and with planted rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm.queries import oracle_sql, queries

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    base = docs.where("length(text) > 900 and lang = 'en'").orderBy("doc_id").limit(2).collect()
    passage = " ".join(f"planted{i}" for i in range(70))
    rows = [(9_000_001, base[0].text, "en", "p", 1), (9_000_002, base[0].text.replace(" the ", " zzz ", 1), "en", "p", 1), (9_000_003, "Und er this " + passage + " ends here", "en", "p", 1), (9_000_004, passage + " " + " ".join(f"other{i}" for i in range(60)), "en", "p", 1), (9_000_005, "12345 67890", "en", "p", 1), (9_000_006, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, out[-1], AT).write.parquet(str(at / name))
        out.append(spark.read.parquet(str(at / name)))
    return out


def test_stages(staged):
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_dedup", "repeat_removal", "packing"]
    for x in staged[1:-1]:
        assert x.columns == P.COLUMNS
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in staged]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert {9_000_005, 9_000_006} <= ids[1] and not {9_000_005, 9_000_006} & ids[2]
    assert not {9_000_001, 9_000_002} & ids[3] and {9_000_003, 9_000_004} <= ids[3]
    text = {r.doc_id: r.text for r in staged[4].where("doc_id >= 9000003").collect()}
    assert "planted30" not in text[9_000_003] and "planted30" not in text[9_000_004] and "ends here" in text[9_000_003]
    assert staged[4].where(F.col("n_chars") != F.length("text")).count() == 0


def test_repeated_passage_of_short_words(spark):
    """51 words of fewer than 256 bytes go from texts that differ around them; 50 words stay."""
    short, less = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("s", 51), ("l", 50)))
    texts = [f"before{k} {x}after{k}" for x in (short + " ", less + " ") for k in ("one", "two")] + ["a b", "a b"]
    assert len(short) < P.REPEAT_BYTES
    docs = spark.createDataFrame([(i, t, "en", "p", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.cut_repeats(spark, docs, AT).collect()}
    assert got == {0: "beforeone  afterone", 1: "beforetwo  aftertwo", **dict(enumerate(texts[2:], 2))}


def test_clean_documents_stay(spark):
    at = "/root/testdata/sf0.01"
    docs, y = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    kept = P.keep_languages(spark, P.drop_toxic(spark, docs, at), at).select("doc_id").cache()
    clean, toxic = y.where("toxic = 0").select("doc_id"), y.where("toxic = 1").select("doc_id")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.99 * clean.count()
    assert kept.join(toxic, "doc_id", "left_semi").count() <= 0.3 * toxic.count()


def test_run_and_names(spark):
    assert P.run(spark, AT).count() > 0
    names = queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(oracle_sql()) <= set(names)


def test_empty_documents(spark):
    x = spark.read.parquet(f"{AT}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        x = stage(spark, x, AT)
        assert x.count() == 0
