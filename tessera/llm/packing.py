"""Variable-capacity best-fit packing.

Texts are packed into training sequences of several permitted lengths. A piece goes to the open bin
that it fits with the least room left over, whatever the bin's size; if none has room, a bin opens in
the size of least cost. When all pieces are placed, each bin shrinks to the smallest permitted length
that holds its contents. Texts longer than the largest length are cut into pieces of that length and
a rest, so every token is packed and none is padded away.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wanted pieces of one packing task. Packing them apart costs at most the open bins of each task.
TASK_PIECES = 20_000
#: Tokens' worth that each bin costs besides its length; large bins share it among more tokens.
BIN_COST = 32


def cheapest(length: int, sizes: Sequence[int], fill: float, cost: int = BIN_COST) -> int:
    """The size to open for a piece: least expected cost for each token that it will hold.

    fill is the mean length of the pieces still to come; a bin is expected to take whole further pieces
    of that length.
    """
    best = None
    for s in sizes:
        if s < length:
            continue
        held = length + (int((s - length) // fill) * fill if fill > 0 else 0)
        # The bin shrinks to its contents in the end.
        shrunk = sizes[bisect_left(sizes, held)]
        rate = ((shrunk + cost) / max(held, 1), -s)
        if best is None or rate < best[0]:
            best = (rate, s)
    if best is None:
        raise ValueError("the piece is longer than every size")
    return best[1]


def pack(lengths: Sequence[int], sizes: Sequence[int], cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each piece, offset in its bin, final size of each bin), by best fit on decreasing lengths."""
    sizes = sorted(sizes)
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    rest = int(np.sum(lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free, -bin) of open bins
    for done, k in enumerate(order.tolist()):
        n = int(lengths[k])
        rest -= n
        at = bisect_left(room, (n, -len(used) - 1))
        if at < len(room):
            free, b = room.pop(at)
            b = -b
        else:
            left = len(lengths) - done - 1
            free, b = cheapest(n, sizes, rest / left if left else 0, cost), len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, -b))
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used]


def word_count(text: Column) -> Column:
    """A text's words, runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def best_fit(df: DataFrame, id_col: str, length: Column, sizes: Sequence[int]) -> DataFrame:
    """(id, piece, start, length, bin, bin_size, offset) for each piece of each row.

    piece counts a row's pieces from 0, start is where the piece starts in the row, bin numbers the bins
    (no gaps within a task, tasks 2^32 apart), bin_size is the final permitted length and offset is where
    the piece lies in the bin. A row of length 0 or null is one piece of length 0 and takes no room. Null
    ids stay, repeated rows are packed each. Only the id and what `length` needs are read, so other
    columns cannot clash. An empty table gives an empty result.
    """
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes are permitted lengths of 1 or more")
    most = sizes[-1]
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    cut = F.expr(f"transform(sequence(0, greatest(cast(ceil(n / {most}) as int) - 1, 0)), i -> struct(i as piece, cast(i as long) * {most} as start))")
    pieces = rows.withColumn("c", F.explode(cut)).select("id", "c.piece", "c.start", F.least(F.lit(most), F.col("n") - F.col("c.start")).alias("length"))
    # Rows are dealt by their contents into tasks of a fixed size, whatever shares an id or a length.
    n = rows.agg(F.count("*"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / most)))).first()
    tasks = max(1, -(-int(n[1] or 0) // TASK_PIECES))
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(tasks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None

        def settle() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            n = t["length"].to_numpy()
            bins, offsets, final = pack(n, sizes)
            for b in t.append_column("bin", pa.array(bins + (task << 32))).append_column("bin_size", pa.array(np.array(final, np.int64)[bins])).append_column("offset", pa.array(offsets)).drop_columns(["task"]).to_batches():
                yield b

        for x in batches:
            at = x.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and at[a] != task:
                        yield from settle()
                        held = []
                    task = int(at[a])
                    held.append(x.slice(a, b - a))
        if held:
            yield from settle()

    parts = min(tasks, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = dealt.select("task", "id", "piece", "start", "length").repartition(parts, "task").sortWithinPartitions("task", F.desc("length"), "id", "piece")
    return sorted_rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, bin long, bin_size long, offset long")
