"""The keyed upsert against brute force on the test tables, the merge on small batches, and odd rows."""

import glob
import hashlib
import math
import os
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, upsert

SF = "/root/testdata/sf0.01"
SETS = ["source", "segment", "city", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def brute_files(rows, changes, most, verdict, columns, key, sets):
    """[(rows of a file, rewritten)] in order, by plain lists."""
    rows = sorted(rows, key=lambda r: r[key])
    start = [rows[a : a + most] for a in range(0, len(rows), most)]
    if not start:
        return []
    firsts = [f[0][key] for f in start]
    best = {}
    for c in changes:
        if c[key] is not None and (c[key] not in best or (c["seq"], c["change_id"]) > (best[c[key]]["seq"], best[c[key]]["change_id"])):
            best[c[key]] = c
    after = [list(f) for f in start]
    for k, c in best.items():
        home = max([i for i, f in enumerate(firsts) if f <= k], default=0)
        what = verdict(c, firsts[home])
        have = [r for r in after[home] if r[key] == k]
        if what == "delete":
            after[home] = [r for r in after[home] if r[key] != k]
        elif what == "set":
            if have:
                after[home] = [{**r, **{s: c[s] for s in sets}} if r[key] == k else r for r in after[home]]
            else:
                after[home].append({x: c[x] if x in sets or x == key else None for x in columns})
                after[home].sort(key=lambda r: r[key])
    out = []
    for old, new in zip(start, after, strict=True):
        if old == new:
            out.append((old, False))
            continue
        parts = -(-len(new) // most)
        a = 0
        for i in range(parts):
            n = len(new) // parts + (i < len(new) % parts)
            piece, a = new[a : a + n], a + n
            if out and out[-1][1] and len(out[-1][0]) + n <= most:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    return out


def verdict12(c, first):
    h = crc(first) % 16
    return "ignore" if h > 7 else "delete" if c["op"] == "D" or crc(c["change_id"]) % 8 < h else "set"


def test_query_equals_brute_force(spark):
    clients = spark.read.parquet(f"{SF}/clients.parquet")
    rows, changes = [r.asDict() for r in clients.collect()], [r.asDict() for r in spark.read.parquet(f"{SF}/client_changes.parquet").collect()]
    want = brute_files([r for r in rows if crc(r["client_id"]) % 7 > 3], changes, 1 + len(rows) // 1000, verdict12, clients.columns, "client_id", SETS)

    def digest(f, rewritten):
        cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in f)
        crcs = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in f)
        return f[0]["client_id"], len(f), cents, crcs, hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), rewritten

    got = sorted(queries.op12_keyed_upsert(spark, SF).collect(), key=lambda r: r.first_id)
    assert [(r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got] == [digest(*f) for f in want]
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    paths = {r.path.removeprefix("file:") for r in got}
    assert paths == set(glob.glob(os.path.dirname(min(paths)) + "/**/*.parquet", recursive=True))
    for (f, _), r in zip(want, got, strict=True):
        held = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert held.column_names == clients.columns and r.columns == ",".join(clients.columns)
        assert held.select(["client_id", *SETS]).to_pylist() == [{c: x[c] for c in ["client_id", *SETS]} for x in f]


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_equal_brute_force(spark, seed):
    """Repeated and null keys, inner names as columns, NaN and null values, keys below all files, inserts that split a file."""
    rng = random.Random(seed)
    schema = "home long, k string, place double, row string"
    rows = [(rng.randrange(60), rng.choice(["a", None]), rng.choice([None, 1.0]), "x") for _ in range(40)]
    rows = [r for i, r in enumerate(rows) if r[0] > 10 and r[0] not in {x[0] for x in rows[:i]}] + [(None, "n", None, "x")]
    changes = [(i, rng.choice([None, *range(80)]), rng.randrange(3), rng.choice("UUD"), rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0])) for i in range(60)]
    table = spark.createDataFrame(rows, schema)
    change = spark.createDataFrame(changes, "change_id long, home long, seq long, op string, k string, place double")
    folder = upsert.new_folder(spark, "upsert-test")
    started = upsert.start_files(table, "home", 7, folder)
    files = upsert.upsert(started, folder, table, change, "home", ["seq", "change_id"], ["k", "place"], lambda c, first: F.when(first % 5 == 0, "ignore").when(c.op == "D", "delete").otherwise("set"), 7)
    as_dicts = [r.asDict() for r in table.where("home is not null").collect()]
    want = brute_files(as_dicts, [r.asDict() for r in change.collect()], 7, lambda c, first: "ignore" if first % 5 == 0 else "delete" if c["op"] == "D" else "set", table.columns, "home", ["k", "place"])
    assert [(f.first, f.rows, f.rewritten) for f in files] == [(f[0]["home"], len(f), x) for f, x in want]
    assert [pq.ParquetFile(f.path.removeprefix("file:")).read().to_pylist() for f in files] == [f for f, _ in want]


def test_empty_sides(spark):
    table = spark.createDataFrame([(i, "a") for i in range(5)], "id long, v string")
    change = spark.createDataFrame([], "id long, seq long, v string")
    folder = upsert.new_folder(spark, "upsert-test")
    every = lambda c, first: F.lit("set")
    files = upsert.start_files(table, "id", 2, folder)
    assert [f.rows for f in files] == [2, 2, 1]
    assert upsert.upsert(files, folder, table, change, "id", ["seq"], ["v"], every, 2) == files
    gone = spark.range(5).select("id", F.lit(1).alias("seq"), F.lit("b").alias("v"))
    assert upsert.upsert(files, folder, table, gone, "id", ["seq"], ["v"], lambda c, first: F.lit("delete"), 2) == []
    assert not glob.glob(folder.removeprefix("file:") + "/part-*")
    nothing = upsert.start_files(table.limit(0), "id", 2, upsert.new_folder(spark, "upsert-test"))
    assert nothing == [] and upsert.upsert([], folder, table, gone, "id", ["seq"], ["v"], every, 2) == []
    assert upsert.file_digests([], table, "id", {}).count() == 0


def test_merge_does_not_depend_on_batches():
    rng = random.Random(1)
    rows = []
    for home in range(4):
        for k in range(12):
            if rng.random() < 0.6:
                rows.append((home, k, 0, rng.random() < 0.3, k, rng.choice([None, 1.0, math.nan])))
            rows += [(home, k, 1, False, k, rng.choice([None, 1.0, math.nan])) for _ in range(rng.choice([0, 1, 1, 3]))]
    names = ["home", "k", "side", "gone", "c0", "c1"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.float64()]
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    def merged(size):
        return [str(r) for b in upsert.merge_sorted(iter(table.to_batches(size)), 2, [1]) for r in b.to_pylist()]

    whole = merged(1000)
    assert all(merged(n) == whole for n in (1, 2, 3, 5, 7))
    want = []
    for home in range(4):
        place = 0
        for k in range(12):
            here = [r for r in rows if r[:2] == (home, k)]
            change, own = [r for r in here if r[2] == 0], [r for r in here if r[2] == 1]
            if change and not own and not change[0][3]:
                own = change
            for r in own:
                live = not (change and change[0][3])
                value = change[0][5] if change and live else r[5]
                same = str(value) == str(r[5]) and live and r[2] == 1
                want.append(str({"home": home, "place": place if live else None, "live": live, "dirty": not same, "c0": k, "c1": value}))
                place += live
    assert whole == want
