"""Copy-on-write keyed upsert of a folder of sorted Parquet files.

Each key has a home, the last file that begins at or below it, else the first. Changes are reduced to one a
key, sent to their homes, and merged there with the file's rows as two sorted streams; the merge tells which
rows differ. Only homes that differ are written anew: the driver folds their row counts into a manifest of
files, each file is streamed by one task, and files that were replaced go once all new ones are there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored
from .numbering import numbered


class DataFile(NamedTuple):
    """A file of the manifest: its path, first key and number of rows, and whether the upsert wrote it."""

    path: str
    first: int
    rows: int
    rewritten: bool


class Planned(NamedTuple):
    """A file to be: an untouched one by its place among the starting files, or one to write, by its number."""

    kept: int | None
    number: int | None
    rows: int


class Split(NamedTuple):
    """How a home's rows are dealt: the first `longer` files of it take size + 1 rows each, the others size; `number` is the first file's."""

    home: int
    size: int
    longer: int
    number: int


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder; it stays."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _paths(spark: SparkSession, folder: str) -> set[str]:
    """Data files directly in a folder: as many as its manifest has rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {str(p.toString()) for p in found if p.getName().startswith("part-")}


def _write(rows: DataFrame, columns: Sequence[str], folder: str, files: int) -> list[str]:
    """Writes rows (row, number, then what orders them) as one sorted file a number; the new files' paths by number."""
    if not files:
        return []
    spark = rows.sparkSession
    before = _paths(spark, folder)
    order = [c for c in rows.columns if c not in ("row", "number")]
    placed = rows.repartitionById(files, F.col("number").cast("int")).sortWithinPartitions("number", *order)
    placed.select(*[F.col("row").getField(c).alias(c) for c in columns]).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
    # A task's number, which is its file's, is the first in the name that Spark gives the file.
    new = {int(p.rsplit("/part-", 1)[1].split("-")[0]): p for p in _paths(spark, folder) - before}
    return [new[i] for i in range(files)]


def start_files(df: DataFrame, key: str, most: int, folder: str) -> list[DataFile]:
    """df sorted by key as files of `most` rows (the last: the rest) in a new folder; rows without a key are left out."""
    rows = df.where(F.col(key).isNotNull()).select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(key).cast("long").alias("lead"))
    rows = stored(numbered(rows, "lead", [F.xxhash64("row")], "place").withColumn("number", F.floor(F.col("place") / most).cast("int")))
    heads = rows.groupBy("number").agg(F.min("lead").alias("first"), F.count("*").alias("n")).orderBy("number").collect()  # a row a file
    paths = _write(rows.select("row", "number", "place"), df.columns, folder, len(heads))
    return [DataFile(p, r["first"], r["n"], False) for p, r in zip(paths, heads, strict=True)]


def latest(changes: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(k, change): each key's change that is highest by the given columns, nulls lowest, further ties by all columns; partial maxima come first."""
    rest = [c for c in changes.columns if c not in by]
    top = F.max(F.struct(*[F.col(c) for c in (*by, *rest)])).alias("change")
    return changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(top)


def with_homes(rows: DataFrame, files: Sequence[DataFile]) -> DataFrame:
    """rows with column home (a place among the files) and home_first for their key k; the files' first keys go with the tasks."""
    firsts = np.array([f.first for f in files], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            home = np.maximum(np.searchsorted(firsts, x.column("k").to_numpy(), "right") - 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(home), pa.array(firsts[home])], names=[*x.schema.names, "home", "home_first"])

    return rows.mapInArrow(run, f"k long, change {rows.schema['change'].dataType.simpleString()}, home int, home_first long")


def _unlike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; nulls are equal, and so are NaNs."""
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    if pa.types.is_floating(a.type):
        same = pc.and_(same, pc.equal(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def merge_sorted(batches: Iterator[pa.RecordBatch], columns: int, sets: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """A home's changes and file rows, merged as two sorted streams.

    Rows are (home, k, side, gone) and the columns c0, c1, ..., by home, k and side; side 0 is a key's change (at
    most one), side 1 the file's rows. Yields (home, place, live, dirty) and the columns: a row that a change
    deletes is not live and has no place, others are numbered from 0 within their home. What is held is a batch
    and the change of the key that is being merged.
    """
    held: pa.RecordBatch | None = None  # the open key's change, and whether it met a row of the file
    met = False
    home_now, place = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch
        if held is not None:
            x = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        home, k, side = (x.column(i).to_numpy() for i in range(3))
        n = len(home)
        opens = np.r_[True, (home[1:] != home[:-1]) | (k[1:] != k[:-1])]
        head = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        changed = side[head] == 0
        rows_of = np.bincount(head[side == 1], minlength=n)
        if held is not None and met:
            rows_of[0] += 1
        last = int(head[-1])
        held, met = (x.slice(last, 1), bool(rows_of[last])) if side[last] == 0 else (None, False)
        out = side == 1
        new = (side == 0) & (rows_of == 0)
        if held is not None:
            new[last] = False  # rows of its key may follow
        part, home_now, place = _merged(x, out, new, head, changed, columns, sets, home_now, place)
        if part is not None:
            yield part
    if held is not None and not met:
        one = np.ones(1, bool)
        part, _, _ = _merged(held, ~one, one.copy(), np.zeros(1, int), one, columns, sets, home_now, place)
        if part is not None:
            yield part


def _merged(x, out, new, head, changed, columns, sets, home_now, place):
    """The result's rows of a batch: rows `out` of the file, under their key's change if there is one, and `new` ones; the counter follows."""
    gone = pc.fill_null(x.column(3), False).to_numpy(zero_copy_only=False)
    new = new & ~gone
    pick = np.flatnonzero(out | new)
    if not len(pick):
        return None, home_now, place
    home, source = x.column(0).to_numpy()[pick], head[pick]
    under = changed[pick] & ~new[pick]
    live = ~(under & gone[source])
    dirty = new[pick] | ~live
    cols = []
    for c in range(columns):
        own = x.column(4 + c).take(pa.array(pick))
        if c in sets and under.any():
            theirs = x.column(4 + c).take(pa.array(source))
            dirty |= under & _unlike(own, theirs)
            own = pc.if_else(pa.array(under & live), theirs, own)
        cols.append(own)
    opens = np.r_[True, home[1:] != home[:-1]]
    alive = np.cumsum(live)
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(home)), 0))
    at = alive - 1 - (alive[begin] - live[begin])
    at = at + np.where(begin == 0, place if home[0] == home_now else 0, 0)
    total = int(at[-1]) + 1
    places = pa.array(at.astype(np.int64), mask=~live)
    part = pa.RecordBatch.from_arrays([pa.array(home), places, pa.array(live), pa.array(dirty), *cols], names=["home", "place", "live", "dirty", *[f"c{i}" for i in range(columns)]])
    return part, home[-1], total


def fold_manifest(files: int, dirty: dict[int, int], most: int, kept_rows: Sequence[int]) -> tuple[list[Planned], list[Split]]:
    """The files to be, in order, and how each home written anew is dealt; `dirty` has such homes' numbers of rows.

    A home is dealt to the fewest files of `most` rows, sizes at most one apart, larger first; then each file that
    is written joins the file left of it, if that is written, too, and both have no more than `most` rows.
    """
    plan: list[Planned] = []
    splits: list[Split] = []
    numbers = 0
    for home in range(files):
        if home not in dirty:
            plan.append(Planned(home, None, kept_rows[home]))
            continue
        if not (rows := dirty[home]):
            continue
        parts = -(-rows // most)
        size, longer = divmod(rows, parts)
        # Two files of one home have more than `most` rows together, so only a home's first file can join.
        for i in range(parts):
            mine = size + (i < longer)
            if plan and plan[-1].kept is None and plan[-1].rows + mine <= most:
                plan[-1] = plan[-1]._replace(rows=plan[-1].rows + mine)
            else:
                plan.append(Planned(None, numbers, mine))
                numbers += 1
            if i == 0:
                splits.append(Split(home, size, longer, plan[-1].number))
    return plan, splits


def upsert(files: Sequence[DataFile], folder: str, table: DataFrame, changes: DataFrame, key: str, by: Sequence[str], sets: Sequence[str], verdict: Callable[[Column, Column], Column], most: int) -> list[DataFile]:
    """Applies changes to the files of a folder, and returns its files in order.

    table gives the files' columns (no row of it is read), key an integer column of both. Of a key's changes the
    highest by the columns `by` counts (nulls lowest, further ties by all columns). verdict(change, first key of
    its home) is a string column: `set` sets the columns `sets` (also to null) of the key's rows, and inserts a row
    with those columns where the home has none, `delete` deletes them, anything else or null does nothing.

    Changes without a key do nothing. Rows of one key in a file are all set or deleted. A home whose rows stay as
    they are keeps its file. Without files there are no homes, and nothing is done; without changes all files
    stay. Columns may have any names. Changes are reduced before they move; a home's rows stream through one task,
    and what the driver holds is a row a file.
    """
    spark = table.sparkSession
    if not files:
        return []
    columns = table.columns
    homed = with_homes(latest(changes, key, by), files)
    homed = homed.withColumn("verdict", verdict(F.col("change"), F.col("home_first"))).where("verdict in ('set', 'delete')")
    kinds = {f.name: f.dataType for f in table.schema}

    def cell(i: int, c: str) -> Column:
        x = F.col("k") if c == key else F.col("change").getField(c) if c in sets else F.lit(None)
        return x.cast(kinds[c]).alias(f"c{i}")

    acts = stored(homed.select("home", "k", F.lit(0).alias("side"), F.lit(0).cast("long").alias("nth"), (F.col("verdict") == "delete").alias("gone"), *[cell(i, c) for i, c in enumerate(columns)]))
    touched = [r.home for r in acts.select("home").distinct().collect()]  # a row a file at most
    if not touched:
        return list(files)
    names = spark.createDataFrame([(files[h].path.rsplit("/", 1)[1], h) for h in touched], "name string, home int")
    old = spark.read.schema(table.schema).parquet(*[files[h].path for h in touched])
    old = old.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("nth"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = columns.index(key)
    rows = old.join(F.broadcast(names), "name").select("home", F.col(f"c{at}").cast("long").alias("k"), F.lit(1).alias("side"), "nth", F.lit(False).alias("gone"), *[f"c{i}" for i in range(len(columns))])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = acts.unionByName(rows).repartition(n, "home").sortWithinPartitions("home", "k", "side", "nth").drop("nth")
    many, set_at = len(columns), [columns.index(c) for c in sets]
    cells = ", ".join(f"c{i} {kinds[c].simpleString()}" for i, c in enumerate(columns))
    merged = stored(both.mapInArrow(lambda x: merge_sorted(x, many, set_at), f"home int, place long, live boolean, dirty boolean, {cells}"))
    counts = merged.groupBy("home").agg(F.max("dirty").alias("dirty"), F.sum(F.col("live").cast("long")).alias("n")).where("dirty").collect()  # a row a file
    plan, splits = fold_manifest(len(files), {r.home: r.n for r in counts}, most, [f.rows for f in files])
    dealt = spark.createDataFrame([tuple(s) for s in splits], "home int, size long, longer long, number int")
    long_rows = F.col("longer") * (F.col("size") + 1)
    part = F.when(F.col("place") < long_rows, F.floor(F.col("place") / (F.col("size") + 1))).otherwise(F.col("longer") + F.floor((F.col("place") - long_rows) / F.col("size")))
    live = merged.where("live").join(F.broadcast(dealt), "home")
    row = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]).alias("row")
    written = sum(p.kept is None for p in plan)
    paths = _write(live.select(row, (F.col("number") + part).cast("int").alias("number"), "home", "place"), columns, folder, written)
    firsts = _firsts(spark, paths, table, key)
    for r in counts:  # the new files are all there
        at_path = spark._jvm.org.apache.hadoop.fs.Path(files[r.home].path)
        at_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at_path, False)
    return [files[p.kept] if p.kept is not None else DataFile(paths[p.number], firsts[paths[p.number].rsplit("/", 1)[1]], p.rows, True) for p in plan]


def _firsts(spark: SparkSession, paths: Sequence[str], table: DataFrame, key: str) -> dict[str, int]:
    """The smallest key of each file, by name."""
    if not paths:
        return {}
    rows = spark.read.schema(table.schema).parquet(*paths).select(F.col("_metadata.file_name").alias("name"), F.col(key).alias("k"))
    return {r.name: r["first"] for r in rows.groupBy("name").agg(F.min("k").alias("first")).collect()}


def file_digests(files: Sequence[DataFile], table: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """(path, first_id, n_rows, sums as long, ids_sha256, rewritten) of each file, by reading it in its own order.

    sums are long columns over the files' rows; ids_sha256 is of the decimal keys joined by commas. One task
    streams a file's keys and terms, and holds one batch of them.
    """
    spark = table.sparkSession
    names = list(sums)
    schema = "number int, first_id long, n_rows long, " + "".join(f"{c} long, " for c in names) + "ids_sha256 string"
    told = spark.createDataFrame([(f.path.rsplit("/", 1)[1], i, f.path, f.rewritten) for i, f in enumerate(files)], "name string, number int, path string, rewritten boolean")
    if not files:
        return told.mapInArrow(lambda x: iter(()), "path string, " + schema.split(", ", 1)[1] + ", rewritten boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, head, total = None, None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"number": now, "first_id": head, "n_rows": total[0], **dict(zip(names, total[1:], strict=True)), "ids_sha256": sha.hexdigest()}], schema=out)

        out = pa.schema([("number", pa.int32()), *[(c, pa.int64()) for c in ("first_id", "n_rows", *names)], ("ids_sha256", pa.string())])
        for x in batches:
            number = x.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                keys = x.column(1).slice(a, b - a).to_pylist()
                if number[a] != now:
                    if now is not None:
                        yield done()
                    now, sha, head, total = int(number[a]), hashlib.sha256(), keys[0], [0] * (1 + len(names))
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, keys)).encode())
                total[0] += b - a
                for i in range(len(names)):
                    total[1 + i] += pc.sum(x.column(2 + i).slice(a, b - a)).as_py() or 0
        if now is not None:
            yield done()

    rows = spark.read.schema(table.schema).parquet(*[f.path for f in files])
    rows = rows.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("nth"), F.col(key).cast("long").alias("k"), *[x.alias(f"s{i}") for i, x in enumerate(sums.values())])
    rows = rows.join(F.broadcast(told.select("name", "number")), "name")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streamed = rows.repartition(n, "number").sortWithinPartitions("number", "nth").select("number", "k", *[f"s{i}" for i in range(len(names))])
    return streamed.mapInArrow(run, schema).join(F.broadcast(told.drop("name")), "number").drop("number")
