"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ann, language, packing, pieces, repeats, sharding, similar, simhash, topk, toxicity
from tessera.operators.components import components
from tessera.llm.textbytes import text_buffer
from tessera.llm.xxh64 import xxh64_ranges

AT = "/root/testdata/sf0.001"
CLASH = ["id", "t", "shard", "fp", "tkey", "score", "slot", "text_crc32", "ranges", "node", "bin"]
TEXTS = [None, "", "  ", "word", "Üñí 🙂 " * 30, "long " * 40_000, "same text here again", "same text here again", "same text here again", "é", "\x00\t\n", "no letters 123".upper()]


def docs(spark, texts=TEXTS, ids=None):
    """Rows with a null id, repeated rows and columns that clash with inner names."""
    ids = ids if ids is not None else [None if i == 3 else i for i in range(len(texts))]
    x = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    x = x.union(x.where("doc_id = 6"))
    return x.withColumns({c: F.lit("clash") for c in CLASH})


def empty(spark):
    return docs(spark).limit(0)


def sample(spark, n=120):
    return spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").limit(n)


# 1 sharding


def test_sharding_contract(spark):
    x = docs(spark)
    rows = sharding.shard_rows(x, "doc_id", "text", [1.0] * 8).collect()
    assert len(rows) == x.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in x.collect())
    assert Counter((r.key, r.size, r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert sharding.shard_rows(empty(spark), "doc_id", "text", [1.0] * 8).count() == 0


def brute_shard(key, weights):
    k = "null" if key is None else f"k{key}"
    score = [-w / math.log(((xxhash.xxh64_intdigest(f"{k}\0{i}".encode(), 42) >> 11) + 0.5) / 2**53) for i, w in enumerate(weights)]
    return score.index(max(score))


@pytest.mark.parametrize("weights", [[1.0] * 8, [0.5, 3.0, 1.0]])
def test_shards_are_those_of_brute_force(spark, weights):
    x = sample(spark, 500).union(docs(spark).select("doc_id", "text"))
    for r in sharding.shard_rows(x, "doc_id", "text", weights).collect():
        assert (r.shard, r.grown_shard) == (brute_shard(r.key, weights), brute_shard(r.key, [*weights, 1.0]))


def test_sharding_follows_weights_and_key(spark):
    x = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r.shard: r["count"] for r in sharding.shard_rows(x, "doc_id", "text", [1.0, 1.0, 2.0]).groupBy("shard").count().collect()}
    assert abs(n[2] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    moved = sharding.shard_rows(x, "doc_id", "text", [1.0] * 8).where("shard <> grown_shard").count()
    assert abs(moved / 20_000 - 1 / 9) < 0.01
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), [])


# 3 SimHash


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids[:a]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in ids]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n🙂z", max_size=90), max_size=8))
def test_fingerprints(texts):
    assert [int(x) for x in simhash.fingerprints(*text_buffer(pa.array(texts, pa.string())))] == [brute_print(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=140), max_size=6))
def test_xxh64(parts):
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    n = np.array([len(p) for p in parts], np.int64)
    got = xxh64_ranges(data, np.r_[0, np.cumsum(n)[:-1]].astype(np.int64) if len(n) else n, n)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_simhash_matches_brute_force(spark):
    src = sample(spark).collect()
    got = {r.id: r for r in simhash.near_duplicates(sample(spark), "doc_id", "text").collect()}
    prints = [brute_print(r.text) for r in src]
    root = brute_components(prints)
    for i, r in enumerate(src):
        want = min(src[j].doc_id for j in range(len(src)) if root[j] == root[i])
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{prints[i]:016x}", want)


def test_simhash_edges(spark):
    x = docs(spark)
    rows = simhash.near_duplicates(x, "doc_id", "text").collect()
    assert len(rows) == x.count()
    by = {r.id: r for r in rows}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[6].component_id == by[7].component_id == by[8].component_id == 6
    assert simhash.near_duplicates(empty(spark), "doc_id", "text").count() == 0


def test_large_posting_is_met_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(1)
    fp = np.unique(np.array([0b111 << 40 | sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) for _ in range(150)], np.uint64))
    (a, b), = simhash._links_of_run(fp, 3, 5)
    want = brute_components([int(x) for x in fp])
    root = {int(x): int(x) for x in fp}
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        assert int(np.searchsorted(fp, u)) == want[int(np.searchsorted(fp, v))]
        root[v] = u
    assert [int(np.searchsorted(fp, root[int(x)])) for x in fp] == want


def test_tally_lets_pairs_go_before_bits_are_looked_at(monkeypatch):
    base = 0x0102030405060708
    five, four = base ^ 0x070000, base ^ 0x01010101  # three bits in one byte; four bits in four bytes
    x = np.array([base, five, four], np.uint64)
    kept = simhash.tallied(simhash._octets(x), simhash._octets(x), 5)
    assert kept.tolist() == [[True, True, False], [True, True, False], [False, False, True]]
    looked = []
    bits = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda v: looked.extend(np.atleast_1d(v).tolist()) or bits(v))
    list(simhash._links_of_run(x, 3, 5))
    assert looked == [base ^ five]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# Similar texts, for the pipeline


def test_similar_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(30)]

    def edited(t, n):
        w = t.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = "edited"
        return " ".join(w)

    texts = base + [edited(b, 1) for b in base] + [edited(b, 60) for b in base] + [base[0], None, "", "  "]
    x = docs(spark, texts, list(range(len(texts))))
    kept = {r.doc_id for r in similar.one_of_each(x, "doc_id", "text").select("doc_id").collect()}
    assert kept == set(range(30)) | set(range(60, 90)) | {91, 93}
    assert similar.one_of_each(empty(spark), "doc_id", "text").count() == 0


def similar_by_hand(texts, words=5, least=0.8):
    """The smallest place of each group of similar texts, by all pairs."""
    sets = [{tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = sorted((up(i), up(j)))
            root[b] = a
    return {up(i) for i in range(len(texts))}


def kept_of(spark, texts):
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in similar.one_of_each(x, "doc_id", "text").select("doc_id").collect()}


def test_similar_texts_of_one_vocabulary(spark):
    """All texts share every posting of their words; a near copy of each is found all the same."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    base = [rng.sample(words, 100) for _ in range(150)]
    near = []
    for w in base:
        i = rng.randrange(10, 90)
        near.append([*w[:i], w[i + 1], w[i], *w[i + 2 :]])
    texts = [" ".join(w) for w in base + near]
    assert similar_by_hand(texts) == set(range(150))
    assert kept_of(spark, texts) == set(range(150))


def test_similar_texts_with_a_block_more(spark):
    """A block appended, put before or taken out, at similarities around 0.8 to 0.95, against all pairs."""
    rng = random.Random(7)
    texts = []
    for n in (8, 16, 25, 36, 45):
        for k in range(24):
            base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
            block = [f"x{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(base), " ".join((base + block, block + base, base[:60] + base[60 + n * 4 // 5 :])[k % 3])]
    want = similar_by_hand(texts)
    assert len(texts) // 2 < len(want) < len(texts)
    assert kept_of(spark, texts) == want


def test_similar_texts_of_one_large_group(spark):
    """Hundreds of different near copies of two texts, many of them similar to few others only, against all pairs."""
    rng = random.Random(11)
    texts = []
    for n, edits in ((260, 6), (90, 9)):
        base = [f"g{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(n):
            w = base[:]
            for i in rng.sample(range(len(w)), rng.randrange(1, edits)):
                w[i] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    want = similar_by_hand(texts)
    assert 2 < len(want) < 350
    assert kept_of(spark, texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.integers(0, 30))
def test_parity_maps_differ_in_no_more_bits_than_sets(a, b, shared):
    a = a + b[:shared]
    x, y = (np.unique(np.array(s, np.uint64)) for s in (a, b))
    m = similar.parity_maps([x, y])
    assert np.bitwise_count(m[0] ^ m[1]).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_partners_of_a_posting(monkeypatch):
    """Each fingerprint with a near one before it gets one such, in blocks as well."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(3)
    fp = np.unique(np.array([sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) for _ in range(150)], np.uint64))
    i, j = similar._partners(fp)
    near = [[(int(x) ^ int(y)).bit_count() <= 3 for x in fp] for y in fp]
    assert all(near[a][b] and a < b for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert sorted(j.tolist()) == [b for b in range(len(fp)) if any(near[a][b] for a in range(b))]


# 4 SentencePiece

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def table():
    return pieces.WordTable(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "▁", "é", "\n", "\t", "the", "🙂", "日", "<s>", "\x00", "\ufeff"]) | st.characters(exclude_categories=("Cs",)), max_size=40))
def test_pieces_match_the_library(table, parts):
    text = "".join(parts)
    ids = table.model.encode(text)
    assert table.encode(text) == (",".join(map(str, ids)), len(ids), table.model.decode(ids))


def test_piece_digests(spark, table):
    model = public_tokenizers.path("piece_bpe_32k.model")
    x = docs(spark)
    got = pieces.encoding_digests(x, "doc_id", "text", model).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in x.collect():
        ids = table.model.encode(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(table.model.decode(ids))] += 1
    assert Counter((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert pieces.encode_texts(x, "doc_id", "text", model).where("id = 0").first().ids == []
    assert pieces.decode_texts(x, "doc_id", "text", model).where("id = 9").first().decoded == "é"
    assert pieces.encoding_digests(empty(spark), "doc_id", "text", model).count() == 0


# 5 language


def test_language_held_out_accuracy(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranked = language.profiles(x.where(language.of_third("doc_id") != 1), "text", "lang")
    held = language.with_language(x.where(language.of_third("doc_id") == 1), "text", ranked)
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert held.where("score < 0 or score > 1").count() == 0


def brute_ranking(texts):
    """The PROFILE most frequent n-grams of texts, most frequent first, ties by their characters' numbers."""
    n = Counter()
    for t in texts:
        low = [c.lower() if len(c.lower()) == 1 else c for c in t]
        words = "".join(c if o.isalpha() else " " for c, o in zip(low, t, strict=True)).split()
        if words:
            marked = "\x01" + "\x01".join(words) + "\x01"
            n.update(g for k in (1, 2, 3) for i in range(len(marked) - k + 1) if (g := marked[i : i + k]) != "\x01")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(n, key=lambda g: (-n[g], code(g)))[: language.PROFILE]


def test_language_matches_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text", "lang").collect()]
    third = {i: zlib.crc32(str(i).encode()) % 3 for i, _, _ in rows}
    langs = sorted({k for i, _, k in rows if third[i] != 1 and k is not None})
    places = {k: {g: p for p, g in enumerate(brute_ranking([t for i, t, v in rows if v == k and third[i] != 1 and t is not None]))} for k in langs}
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.with_language(x, "text", language.profiles(x.where(language.of_third("doc_id") != 1), "text", "lang"))
    for r in got.collect():
        mine = brute_ranking([r.text or ""])
        far = {k: sum(abs(places[k][g] - i) if g in places[k] else language.PROFILE for i, g in enumerate(mine)) for k in langs}
        want = (min(langs, key=lambda k: (far[k], k)), 1 - min(far.values()) / (language.PROFILE * len(mine))) if mine else ("und", 0.0)
        assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1])), r.doc_id


def test_language_edges(spark):
    x = docs(spark).withColumns({"lang": F.when(F.col("doc_id") > 3, "en")})
    ranked = language.profiles(x, "text", "lang")
    got = language.with_language(x, "text", ranked)
    assert got.columns.count("score") == 1 and got.count() == x.count()
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 10)) and by[9].lang_pred == "en"
    assert language.profiles(empty(spark).withColumn("lang", F.lit("en")), "text", "lang") == {}
    assert {r.lang_pred for r in language.with_language(x, "text", {}).collect()} == {"und"}


# 6 repeats


def brute_repeats(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] >= 2:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6), st.sampled_from([8, 12, 24]), st.integers(0, 3))
def test_merge_of_transforms(texts, length, salt):
    p = [t.encode() for t in texts]
    w = [1 + ((i + salt) % 3 == 0) for i in range(len(p))]
    old = repeats.SHARD_BYTES
    repeats.SHARD_BYTES = 40
    try:
        got = repeats.repeated_starts(p, w, length)
    finally:
        repeats.SHARD_BYTES = old
    assert [g.tolist() for g in got] == [g.tolist() for g in repeats._by_bytes(p, w, length)]


def test_common_prefixes_of_a_merge():
    data = [b"abababcd", b"ababxy"]
    shards = [repeats.Transform(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 1) for d in data]
    order, block, common = repeats.merge(shards, 4)
    text = [data[0][s:] for s in shards[0].start] + [data[1][s:] for s in shards[1].start]
    sfx = [text[i] for i in order]
    for a, b, n in zip(sfx, sfx[1:], common[1:], strict=False):
        assert n == next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or i >= len(a)), 4)


@pytest.mark.parametrize("length", [400, 40, 20])
def test_repeats_match_brute_force(spark, length):
    src = sample(spark, 200).collect()
    want = brute_repeats([(r.text or "").encode() for r in src], length)
    got = {r.id: tuple(r)[1:] for r in repeats.removal_digests(sample(spark, 200), "doc_id", "text", length).collect()}
    assert [got[r.doc_id][:4] for r in src] == want
    # The kept text has the kept bytes, but for characters that a run cuts through.
    for r in src:
        n, gone, many, sha, text = got[r.doc_id]
        assert n - gone - 6 * many <= len(text.encode()) <= n - gone and (len(text.encode()) < n - gone or hashlib.sha256(text.encode()).hexdigest() == sha)


def test_repeats_edges(spark):
    x = docs(spark)
    src = x.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(src, brute_repeats([(r.text or "").encode() for r in src], 16), strict=True))
    assert Counter(tuple(r)[:5] for r in repeats.removal_digests(x, "doc_id", "text", 16).collect()) == want
    cut = {r.doc_id: r for r in repeats.without_repeats(x, "text", 16).collect()}
    assert cut[0].text is None and cut[6].text == "" and cut[5].text == "" and cut[9].text == "é" and cut[9].tkey == "clash"
    assert repeats.removal_digests(empty(spark), "doc_id", "text", 16).count() == 0


def test_large_anchor_is_counted(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 100)
    src = sample(spark, 120).collect()
    want = brute_repeats([(r.text or "").encode() for r in src], 40)
    got = {r.id: tuple(r)[1:5] for r in repeats.removal_digests(sample(spark, 120), "doc_id", "text", 40).collect()}
    assert [got[r.doc_id] for r in src] == want


# 7 top-k


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [1, None, 0, 0, 0, 0]), (None, [1] * 6), (62, [1, 2]), (3, rng.choices(range(3), k=6))]
    x = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("score", F.lit("clash"))
    q = x.where("vec_id % 7 = 0")
    got = {}
    for r in topk.top_k(q, x, "vec_id", "v", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    good = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    for i, v in good:
        if i % 7 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v)))[:5]
            assert got[i] == [(j, -t) for t, j in s]
    assert topk.top_k(q.limit(0), x, "vec_id", "v", 5).count() == 0 and topk.top_k(q, x.limit(0), "vec_id", "v", 5).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30), st.integers(1, 8))
def test_selection_breaks_ties_by_id(scores, k):
    ids = np.array([(7 * i) % 31 for i in range(len(scores))])
    got = topk.select_top(np.array(scores), ids, k)
    assert got.tolist() == sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]


# 8 packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_packing_is_best_fit(lengths):
    sizes = [16, 32, 64]
    bins, offsets, final = packing.pack(lengths, sizes)
    held = {}
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        held.setdefault(b, []).append((o, n))
    assert sorted(held) == list(range(len(final)))
    for b, parts in held.items():
        used = sum(n for _, n in parts)
        assert final[b] == min(s for s in sizes if s >= used)
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n


def brute_pack(lengths, sizes):
    """Every bin is looked at for every piece, and every size for every bin that opens."""
    left, bins, room, used = list(lengths), {}, [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        left.remove(n)
        fits = [b for b, free in enumerate(room) if free > 0 and free >= n]
        if fits:
            b = min(fits, key=lambda b: (room[b], -b))
        else:
            mean = sum(left) / len(left) if left else 0

            def rate(s, n=n, mean=mean):
                held = n
                while mean > 0 and held + mean <= s + 1e-9:
                    held += mean
                return ((min(z for z in sizes if z >= held - 1e-9) + packing.BIN_COST) / max(held, 1), -s)

            b = len(room)
            room.append(min((s for s in sizes if s >= n), key=rate))
            used.append(0)
        bins[k] = b
        room[b] -= n
        used[b] += n
    return [bins[k] for k in range(len(lengths))], [min(s for s in sizes if s >= u) for u in used]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 4, 8, 16, 20, 32, 48, 64]), max_size=50))
def test_packing_matches_brute_force(lengths):
    bins, _, final = packing.pack(lengths, [16, 32, 64])
    want, sizes = brute_pack(lengths, [16, 32, 64])
    assert (bins.tolist(), final) == (want, sizes)


def test_least_cost_size():
    assert packing.cheapest(60, [16, 32, 64], 0) == 64
    assert packing.cheapest(40, [16, 32, 64], 30, cost=0) == 64
    # A size that fills up exactly is cheaper than one that leaves room which nothing will take.
    assert packing.cheapest(10, [16, 20, 64], 10, cost=0) == 20
    assert packing.cheapest(10, [16, 64], 9, cost=8) == 64
    with pytest.raises(ValueError):
        packing.cheapest(65, [64], 0)


def test_packing_covers_every_token(spark):
    x = docs(spark)
    out = packing.best_fit(x, "doc_id", packing.word_count(F.col("text")), [64, 256]).collect()
    words = {}
    for r in x.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    got = {}
    for r in out:
        got[r.id] = got.get(r.id, 0) + r.length
    assert got == words and all(r.length <= r.bin_size and r.offset + r.length <= r.bin_size for r in out)
    assert packing.best_fit(empty(spark), "doc_id", packing.word_count(F.col("text")), [64]).count() == 0


# 9 neighbours


def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet(f"{AT}/embeddings.parquet")
    data = rows.collect()
    e = np.array([r.embedding for r in data], float)
    ids = np.array([r.vec_id for r in data])
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = e @ e[i]
        s[i] = -9
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = got[int(ids[i])]
        hits, total = hits + len(want & {j for j, _ in mine}), total + 20
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and len(mine) == 20
        assert all(math.isclose(t, float(s[np.flatnonzero(ids == j)[0]]), abs_tol=1e-12) for j, t in mine)
    assert hits / total >= 0.9


def test_neighbours_keep_double_precision(spark):
    """Doubles beyond what single precision tells apart, or holds, are scored as they are."""
    rng = random.Random(2)
    for scale in (1.0, 1e60):
        rows = [(i, [scale * (1 + rng.random() * 1e-12), scale * rng.random()]) for i in range(60)]
        x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        by = dict(rows)
        for r in ann.nearest(x, x.where("vec_id = 0"), "vec_id", "embedding", 60).collect():
            assert r.score == (np.array(by[r.id]) * np.array(by[0])).sum()


def test_neighbours_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 128)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = rows.collect()
    e, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert ann.nodes(rows, "vec_id", "embedding", 21).select("block").distinct().count() >= 3
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = e @ e[i]
        s[i] = -np.inf
        hits.append(len(got[int(ids[i])] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.6, 0.8]), (51, None), (52, [0.0, 0.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {}
    for r in ann.nearest(x, x.where("vec_id % 20 = 0 or vec_id >= 50"), "vec_id", "embedding", 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {0: list(range(1, 21)), 20: list(range(20)), 50: list(range(20))}
    assert ann.nearest(x.limit(0), x.limit(0), "vec_id", "embedding", 5).count() == 0


# 10 toxicity


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit_chain(d, y.where("doc_id % 3 <> 1"), "doc_id", "text", ["low_quality", "toxic"])
    held = toxicity.with_toxicity(d.join(y.where("doc_id % 3 = 1").withColumnRenamed("toxic", "y"), "doc_id").select("doc_id", "text", "y"), "text", chain, "toxic")
    r = held.agg(*[F.count_if(F.expr(e)) for e in ("toxic and y = 1", "y = 1", "toxic and y = 0", "y = 0")]).first()
    assert r[0] / r[1] > 0.8 and r[2] / r[3] < 0.01


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    y0 = rng.integers(0, 2, 600)
    rows = [np.array([k for k in (0 if a else 1, 2 + int(rng.integers(0, 20)))]) for a in y0]
    chain = toxicity.Chain(["first", "second"], features=64).fit(rows, np.column_stack([y0, y0]))
    assert chain.models[1].v.shape == (1,) and chain.models[1].v[0] > 0
    p = chain.predict([np.array([0]), np.array([1])])
    assert p[0, 0] > 0.9 > 0.1 > p[1, 0] and p[0, 1] > 0.9 > 0.1 > p[1, 1]
    # What the first link says enters the second: without it the second says something else.
    chain.models[0].w[:], chain.models[0].b = 0, -30.0
    assert abs(chain.predict([np.array([0])])[0, 1] - p[0, 1]) > 0.001


def chain_by_hand(chain, rows):
    """Probabilities of a chain, a row and a link at a time."""
    out = []
    for r in rows:
        p = []
        for m in chain.models:
            margin = m.b + sum(float(m.w[k]) for k in r) + sum(float(v) * q for v, q in zip(m.v, p, strict=True))
            p.append(1 / (1 + math.exp(-margin)))
        out.append(p)
    return out


def test_chain_of_the_query_ends_in_toxicity(spark):
    """The query's links in their order, their out-of-fold inputs and outputs recomputed by hand on a small table."""
    from tessera.llm.queries import fitted_chain

    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = fitted_chain(d, y)
    assert chain.categories == ["low_quality", "toxic"] and chain.models[1].v[0] != 0
    some = d.where("text is not null").limit(40)
    hashed = toxicity.Hasher()
    want = {r.doc_id: chain_by_hand(chain, [hashed(r.text).tolist()])[0] for r in some.collect()}
    for r in toxicity.with_toxicity(some, "text", chain, "toxic").collect():
        assert np.allclose([r.p_low_quality, r.p_toxic], want[r.doc_id]) and r.toxic == (r.p_toxic >= chain.cuts[1] and bool(len(hashed(r.text))))


def test_out_of_fold_probabilities_come_from_models_without_the_row():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(80)]
    y = np.array([int(3 in r) for r in rows])
    chain = toxicity.Chain(["a", "b"], features=16).fit(rows, np.column_stack([y, y]))
    x = toxicity.Rows(rows, np.zeros((80, 0)))
    fold = np.arange(80) % toxicity.FOLDS
    out = np.zeros(80)
    for f in range(toxicity.FOLDS):
        held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        out[held] = toxicity.Linear(16, 0).fit(x.take(rest), y[rest].astype(float)).probabilities(x.take(held))
    again = toxicity.Linear(16, 1).fit(toxicity.Rows(rows, out[:, None]), y.astype(float))
    assert np.allclose(again.v, chain.models[1].v) and np.allclose(again.w, chain.models[1].w)


def test_toxicity_edges(spark):
    x = docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit_chain(x, none, "doc_id", "text", ["toxic"])
    got = toxicity.with_toxicity(x, "text", chain, "toxic").collect()
    assert len(got) == x.count() and all(r.p_toxic == 0.5 and not r.toxic for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(6, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(x, labels, "doc_id", "text", ["toxic"])
    assert not any(r.toxic for r in toxicity.with_toxicity(x.where("text is null or trim(text) = ''"), "text", chain, "toxic").collect())
    assert toxicity.with_toxicity(empty(spark), "text", chain, "toxic").count() == 0
