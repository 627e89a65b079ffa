"""License scans and importance resampling against brute force, and on nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import notices, queries, resampling

AT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["id", "t", "n_words", "spans", "rank", "score", "bucket", "weight", "_part"]
TEXTS = [
    None, "", " \n", "MIT License", "mit-license mit\tlicense", "Released under the MIT Licence.", "emit license", "CC BY-NC 4.0", "cc,by cc by",
    "GNU Genral Publik License, GNU General Public License", "Apache\x00License apache license Apache Lisence", "é apache license x", "long word " * 30_000 + "apache license",
    "same text of words " * 8, "same text of words " * 8, "all rights reserved",
]


def rows(spark, texts=TEXTS):
    x = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return x.union(x.where("doc_id = 13")).withColumns({c: F.lit("clash") for c in CLASH})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    found = [(i, x.label) for x in notices.BASE for p in [x.phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({y for _, y in found}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_labels(text):
    words = WORD.findall(lower(text))
    out = set()
    for x in notices.BASE + notices.FURTHER:
        n = len(x.phrase.split())
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + n + x.edits) + 1):
                part = " ".join(words[i:j])
                if abs(len(part) - len(x.phrase)) <= x.edits and distance(part, x.phrase) <= x.edits:
                    out.add(x.label)
    return ",".join(sorted(out))


def report(df):
    return notices.license_report(notices.scan_notices(df, "doc_id", "text"))


def test_license_scan_on_odd_rows(spark):
    df = rows(spark)
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in report(df).collect())
    assert got == Counter((r.doc_id, *brute_base(r.text)) for r in df.select("doc_id", "text").collect())
    by_id = {r.id: r for r in report(df).collect()}
    assert by_id[5].labels == "mit" and by_id[5].base_labels == "" and 0.8 < by_id[5].score < 1
    assert by_id[7].labels == "cc-by,cc-by-nc" and by_id[7].score == 1.0 and by_id[13].score == 0.0
    assert report(df.limit(0)).count() == 0


def test_license_scan_of_documents(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, AT).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_base(r.text)


def test_edited_notices_are_found_as_by_edit_distance():
    rng = random.Random(5)
    scanner = notices.Scanner(notices.BASE + notices.FURTHER)
    for _ in range(250):
        x = rng.choice(scanner.notices)
        phrase = list(x.phrase)
        for _ in range(rng.randint(0, x.edits + 2)):
            p = rng.randrange(len(phrase))
            kind = rng.randrange(3)
            phrase[p : p + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdeé ")]
        text = f"some words {''.join(phrase)} and {rng.choice(scanner.notices).phrase} end"
        found = scanner.scan(text.encode())[1]
        assert ",".join(sorted({scanner.notices[y.notice].label for y in found})) == brute_labels(text), text
        words = WORD.findall(text)
        for y in found:
            assert distance(" ".join(words[y.first : y.last + 1]), scanner.notices[y.notice].phrase) <= scanner.notices[y.notice].edits


def test_a_notice_needs_more_letters_than_edits():
    with pytest.raises(ValueError):
        notices.Scanner([notices.Notice("mit", "mit", 2)])


def brute_resample(docs, target, n, buckets, least, percent):
    def features(text):
        w = [x.encode() for x in WORD.findall(lower(text))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + m])) % buckets for m in range(1, n + 1) for i in range(len(w) - m + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        many, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((many, (i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))))
    able = sorted((x for many, x in out if many >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = len(able) * percent // 100
    ranked = [(*x, k + 1 if k < drawn else None) for k, x in enumerate(able)]
    return Counter(ranked + [(*x, None) for many, x in out if many < least])


@pytest.mark.parametrize("n,buckets,least,percent", [(1, 10_000, 20, 10), (3, 97, 2, 50), (2, 1, 0, 100)])
def test_resampling_equals_brute_force(spark, n, buckets, least, percent):
    df = rows(spark)
    target = spark.createDataFrame([("same text of benchmark words",), (None,), ("apache license",)], "text string")
    got = resampling.resample(df, target, "doc_id", "text", "text", n, buckets, least, percent)
    want = brute_resample([tuple(r) for r in df.select("doc_id", "text").collect()], [r.text for r in target.collect()], n, buckets, least, percent)
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    got = Counter(map(tuple, queries.op11_importance_resampling(spark, AT).select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert got == brute_resample(docs, target, 1, 10_000, 20, 10)


def test_resampling_of_nothing(spark):
    df = rows(spark)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(df.limit(0), none, "doc_id", "text", "text").count() == 0
    assert resampling.resample(df, none, "doc_id", "text", "text").count() == df.count()
    with pytest.raises(ValueError):
        resampling.resample(df, none, "doc_id", "text", "text", n=0)
