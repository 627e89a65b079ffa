"""Suffix-array deduplication: remove every byte covered by a long string that starts anywhere else.

Texts are bytes; a string of `length` bytes that starts at two places, in one text or in two, covers
removed bytes. The suffixes that can begin such a string are found first, then sorted by merging
shard Burrows-Wheeler transforms:

1. Parse. A start's anchor is the least hash of the short strings (64 bytes for 400) in its window of
   `length` bytes, a value that equal windows share. A run is a stretch of starts with one anchor at one
   place, and its piece is the bytes its windows cover. An anchor met once is no part of any repeat.
2. A piece that occurs twice repeats from end to end, and is decided by its count.
3. Distinct pieces under one anchor agree in part. They are dealt by anchor into groups of bounded
   size. In a group each shard of pieces gets its own transform over an alphabet of 50-byte symbols, in
   the form of first symbols and successor ranks. The shards are then merged by iterative
   interleave refinement: round h orders the interleave by first symbol and by the place of the
   successor after round h - 1, which merges runs that are already sorted, and the round in which two
   neighbours part gives their common prefix. After 8 rounds of 50 bytes the blocks that hold two
   suffixes are the repeated intervals. A last pass compares their bytes.
4. An anchor with more than GROUP_BYTES of distinct pieces is not held in one task: its windows are
   counted by a 128-bit hash, start by start, over the whole cluster.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored
from .simhash import _SPACES
from .textbytes import STEP_BYTES, slices, steps, text_buffer

#: Bytes of pieces in a shard that gets a transform of its own, and in a group whose shards are merged.
SHARD_BYTES = 512 << 10
GROUP_BYTES = 4 << 20
#: Wanted bytes of a group.
TARGET_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """1, x, x^2, ... modulo 2^64, n values at least; x is the base or its inverse."""
    if len(_powers.get(which, ())) < n:
        x = np.full(max(n, STEP_BYTES + 4096), _BASE if which == "up" else _BACK, np.uint64)
        x[0] = 1
        _powers[which] = np.cumprod(x)
    return _powers[which][:n]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of each `width`-byte string of data, the same wherever it stands."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _power("back", n - width + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` neighbours, the first of equal ones."""
    if len(h) < width:
        return np.zeros(0, np.int32)
    at = np.arange(len(h), dtype=np.int32)

    def closer(by: int) -> None:
        nonlocal h, at
        n = len(h) - by
        later = h[by:] < h[:n]
        h, at = np.where(later, h[by:], h[:n]), np.where(later, at[by:], at[:n])

    reach = 1
    while reach * 2 <= width:
        closer(reach)
        reach *= 2
    if width > reach:
        closer(width - reach)
    return at


def anchor_width(length: int) -> int:
    """Bytes of an anchor for strings of a length: 64 for 400."""
    return max(1, length * 4 // 25)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, starts, the anchor's place after the first start) of each run in texts that lie one after another."""
    short = anchor_width(length)
    hashed = rolling(data, short)
    low = _least(hashed, length - short + 1)
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int8)
    fits = size >= length
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - length + 1, -1)
    live = np.cumsum(valid)[: len(low)] > 0
    new = np.r_[True, low[1:] != low[:-1]]
    new[offsets[:-1][offsets[:-1] < len(low)]] = True
    new |= live != np.r_[False, live[:-1]]
    head = np.flatnonzero(new)
    many = np.diff(np.r_[head, len(low)])
    ok = live[head]
    place = low[head[ok]].astype(np.int64)
    return hashed[place], head[ok], many[ok], place - head[ok]


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, start in that row); a very long text comes in overlapping segments."""
    for a, b in steps(offsets):
        lo, hi = offsets[a], offsets[b]
        if b > a + 1 or hi - lo <= STEP_BYTES:
            yield raw[lo:hi], offsets[a : b + 1] - lo, a, 0
            continue
        for at in range(0, int(hi - lo), STEP_BYTES):
            part = raw[lo + at : min(lo + at + STEP_BYTES + length - 1, hi)]
            yield part, np.array([0, len(part)]), a, at


def _runs(df: DataFrame, length: int) -> DataFrame:
    """(anchor, span, tkey, tlen, lo, shape) of every run; df has tkey, tlen, t. shape: starts, and the anchor's place times 2^16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for x in batches:
            # A text's third and later copies in a task tell nothing that two have not told.
            keep = []
            for key in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                met[key] += 1
                keep.append(key[1] >= length and met[key] <= 2)
            x = x.filter(pa.array(keep, pa.bool_()))
            if not x.num_rows:
                continue
            key, size = x.column(0).to_numpy(), x.column(1).to_numpy()
            for raw, offsets, row, at in _segments(*text_buffer(x.column(2)), length):
                anchor, lo, n, place = runs_of(raw, offsets, length)
                if not len(lo):
                    continue
                of = np.searchsorted(offsets, lo, "right") - 1
                flat = memoryview(raw)
                span = [xxhash.xxh3_64_intdigest(flat[i : i + m]) for i, m in zip(lo.tolist(), (n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(np.array(span, np.uint64).view(np.int64)),
                        pa.array(key[row + of]), pa.array(size[row + of]),
                        pa.array(lo - offsets[of] + at), pa.array((n + (place << 16)).astype(np.int32)),
                    ],
                    names=["anchor", "span", "tkey", "tlen", "lo", "shape"],
                )

    return df.select("tkey", "tlen", "t").mapInArrow(run, "anchor long, span long, tkey long, tlen int, lo long, shape int")


def symbol_width(length: int) -> int:
    """The widest divisor of the length up to 64 bytes."""
    return max(d for d in range(1, 65) if length % d == 0)


class Transform:
    """The transform of one shard: first symbols and successor ranks, in suffix order."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int) -> None:
        hashed = rolling(data, width)
        end = np.repeat(bounds[1:], np.diff(bounds))
        at = np.flatnonzero(np.arange(len(hashed)) + width <= end[: len(hashed)])
        symbol = hashed[at]
        entry = np.full(len(data) + width, -1, np.int64)
        entry[at] = np.arange(len(at))
        ahead = np.where(at + width < end[at], entry[at + width], -1)
        rank = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
        hop, top = ahead.copy(), 0
        while len(at):
            key = (rank << 32) | np.where(hop >= 0, rank[hop] + 1, 0)
            values, rank = np.unique(key, return_inverse=True)
            if len(values) in (len(at), top):
                break
            top = len(values)
            hop = np.where(hop >= 0, hop[hop], -1)
        order = np.argsort(rank, kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        # A shard is far below 2^31 bytes.
        self.start = at[order].astype(np.int32)
        self.symbol = symbol[order]
        self.next = np.where(ahead[order] >= 0, place[ahead[order]], -1).astype(np.int32)


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, block, common): entries of all shards in the order of their first `rounds` symbols.

    Entries count through the shards one after another. block numbers the entries of equal first symbols,
    common is the number of symbols, up to `rounds`, that an entry shares with the one before it.
    """
    n = sum(len(s.start) for s in shards)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    # Places and numbers are kept in 32 bits; a group is far below 2^31 entries.
    base = np.cumsum([0, *(len(s.start) for s in shards)])
    ahead = np.concatenate([np.where(s.next >= 0, s.next + np.int32(b), np.int32(-1)) for s, b in zip(shards, base.tolist(), strict=False)])
    hashed = np.concatenate([s.symbol for s in shards])
    symbol = np.searchsorted(np.unique(hashed), hashed).astype(np.int32)
    del hashed
    place, block_of = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)

    def keys(of_next: np.ndarray) -> np.ndarray:
        """First symbols, each with a number of the successor, from 1, or 0 without one."""
        key = symbol.astype(np.int64) << 32
        key |= np.where(ahead >= 0, of_next[ahead] + 1, 0)
        return key

    for done in range(rounds):
        # Each shard's part is in order already: a stable merge of sorted runs.
        order = np.argsort(keys(place), kind="stable").astype(np.int32)
        prefix = (keys(block_of) if done else symbol)[order]
        same = prefix[1:] == prefix[:-1]
        del prefix
        place[order] = np.arange(n, dtype=np.int32)
        block_of[order] = np.cumsum(np.r_[True, ~same], dtype=np.int32) - 1
    # What two neighbours share, counted along the successors while symbols agree.
    common = np.zeros(n, np.int32)
    live, left, right = np.arange(1, n, dtype=np.int32), order[:-1], order[1:]
    for _ in range(rounds):
        agree = symbol[left] == symbol[right]
        live, left, right = live[agree], ahead[left[agree]], ahead[right[agree]]
        common[live] += 1
        on = (left >= 0) & (right >= 0)
        live, left, right = live[on], left[on], right[on]
    return order, block_of[order], common


def repeated_starts(pieces: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each piece, the starts whose `length` bytes occur elsewhere; a piece of weight 2 occurs twice itself."""
    width = symbol_width(length)
    rounds = length // width
    bounds = np.cumsum([0, *map(len, pieces)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    shards, froms, held, size = [], [], [], 0
    for k, p in enumerate([*pieces, b""]):
        if held and (k == len(pieces) or size + len(p) > SHARD_BYTES):
            ends = bounds[held[0] : held[-1] + 2]
            shards.append(Transform(data[ends[0] : ends[-1]], ends - ends[0], width))
            froms.append(ends[0])
            held, size = [], 0
        held.append(k)
        size += len(p)
    start = np.concatenate([s.start + int(f) for s, f in zip(shards, froms, strict=True)])
    order, number, common = merge(shards, rounds)
    del shards
    start = start[order]
    piece = np.searchsorted(bounds, start, "right") - 1
    weight = np.asarray(weights)[piece]
    deep = common >= rounds
    total = np.bincount(number, weight)
    full = start + length <= bounds[piece + 1]
    hit = full & (total[number] >= 2)
    if not _same_bytes(data, start, deep & hit, length):
        return _by_bytes(pieces, weights, length)
    found = np.sort(start[hit])
    cuts = np.searchsorted(found, bounds)
    return [found[cuts[k] : cuts[k + 1]] - bounds[k] for k in range(len(pieces))]


def _same_bytes(data: np.ndarray, start: np.ndarray, deep: np.ndarray, length: int) -> bool:
    """Whether each marked entry has the bytes of the entry before it."""
    at = np.flatnonzero(deep)
    i, j = start[at], start[at - 1]
    turn = np.argsort(i)
    i, j = i[turn], j[turn]
    # One byte tells for a pair that follows on another.
    on = np.r_[False, (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)] if len(i) else np.zeros(0, bool)
    if not (data[i[on] + length - 1] == data[j[on] + length - 1]).all():
        return False
    i, j = i[~on], j[~on]
    for a in range(0, len(i), 4096):
        k = np.arange(length)
        if not (data[i[a : a + 4096, None] + k] == data[j[a : a + 4096, None] + k]).all():
            return False
    return True


def _by_bytes(pieces: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """The same by comparing whole windows; only for a group where two symbols' hashes collide."""
    count: Counter = Counter()
    for p, w in zip(pieces, weights, strict=True):
        for i in range(len(p) - length + 1):
            count[p[i : i + length]] += w
    return [np.array([i for i in range(len(p) - length + 1) if count[p[i : i + length]] >= 2], np.int64) for p in pieces]


def _stretches(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered byte ranges of sorted starts whose windows join."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return starts[cut], starts[np.r_[cut[1:] - 1, len(starts) - 1]] + length


def with_partner(pieces: list[tuple[int, int, bytes]], length: int) -> list[bool]:
    """Whether another piece (anchor, place of the anchor, bytes) has this one's anchor and context on a side.

    A window holds half of its further bytes or more on one side of its anchor, so pieces that agree with
    no other on either of these halves repeat nothing.
    """
    short = anchor_width(length)
    half = (length - short) // 2
    sides, count = [], Counter()
    for anchor, place, p in pieces:
        left = (anchor, 0, xxhash.xxh3_64_intdigest(p[place - half : place + short])) if place >= half else None
        right = (anchor, 1, xxhash.xxh3_64_intdigest(p[place : place + short + half])) if len(p) >= place + short + half else None
        sides.append((left, right))
        count.update(s for s in (left, right) if s)
    return [any(s and count[s] > 1 for s in x) for x in sides]


def _merged(partition_col: str, pieces: DataFrame, length: int) -> DataFrame:
    """(tkey, tlen, lo, hi) of repeats among the pieces of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[int, int, int, bytes]] = {}
        group = None

        def settle() -> Iterator[pa.RecordBatch]:
            rows = [(k, w, p) for k, (w, _, _, p) in held.items()]
            may = with_partner([x[1:] for x in held.values()], length)
            rows = [r for r, ok in zip(rows, may, strict=True) if ok]
            if not rows:
                return
            found = repeated_starts([p for _, _, p in rows], [w for _, w, _ in rows], length)
            out = []
            for ((key, size, lo), w, _), starts in zip(rows, found, strict=True):
                if w < 2 and len(starts):
                    out += [(key, size, lo + int(a), lo + int(b)) for a, b in zip(*_stretches(starts, length), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["tkey", "tlen", "lo", "hi"])

        for x in slices(batches):
            for g, key, size, lo, w, anchor, place, p in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if g != group and held:
                    yield from settle()
                    held = {}
                group = g
                held[key, size, lo] = (w, anchor, place, p)
        if held:
            yield from settle()

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(partition_col, "tkey", "tlen", "lo", "w", "anchor", "place", "piece")
    return rows.repartition(n, partition_col).sortWithinPartitions(partition_col).mapInArrow(run, "tkey long, tlen int, lo long, hi long")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """(tkey, tlen, lo, hi) of repeats among pieces of anchors too large for one task, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for key, size, lo, w, p in zip(*(c.to_pylist() for c in x.columns), strict=True):
                many = len(p) - length + 1
                wide = [hashlib.blake2b(p[i : i + length], digest_size=16).digest() for i in range(many)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wide, pa.binary()), pa.array([key] * many, pa.int64()), pa.array([size] * many, pa.int32()), pa.array(range(lo, lo + many), pa.int64()), pa.array([w] * many, pa.int64())],
                    names=["window", "tkey", "tlen", "lo", "w"],
                )

    windows = pieces.select("tkey", "tlen", "lo", "w", "piece").dropDuplicates(["tkey", "tlen", "lo"]).mapInArrow(run, "window binary, tkey long, tlen int, lo long, w long")
    twice = windows.groupBy("window").agg(F.sum("w").alias("total")).where("total >= 2").select("window")
    return windows.join(twice, "window").where("w < 2").select("tkey", "tlen", "lo", (F.col("lo") + length).alias("hi"))


def _short_passages(texts: DataFrame, words: int, length: int) -> DataFrame:
    """(tkey, tlen, lo, hi) of runs of so many words, in fewer than `length` bytes, that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            raw, offsets = text_buffer(x.column(0))
            space = np.r_[_SPACES[raw], True]
            # A word ends with its text, whatever follows.
            edge = np.zeros(len(raw) + 1, bool)
            edge[offsets] = True
            start = np.flatnonzero(~space & (edge | np.r_[True, space[:-1]]))
            end = np.flatnonzero(~space[:-1] & (space[1:] | edge[1:])) + 1
            if len(start) < words:
                continue
            lo, hi = start[: len(start) - words + 1], end[words - 1 :]
            doc = np.searchsorted(offsets, lo, "right") - 1
            some = np.flatnonzero((hi - lo < length) & (hi <= offsets[doc + 1]))
            lo, hi, doc = lo[some], hi[some], doc[some]
            data = raw.tobytes()
            wide = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(wide, pa.binary()), x.column(1).take(at), x.column(2).take(at), pa.array(lo - offsets[doc]), pa.array(hi - offsets[doc])], names=["passage", "tkey", "tlen", "lo", "hi"])

    passages = texts.select("t", "tkey", "tlen").mapInArrow(run, "passage binary, tkey long, tlen int, lo long, hi long")
    twice = passages.groupBy("passage").count().where("count >= 2").select("passage")
    return passages.join(twice, "passage").select("tkey", "tlen", "lo", "hi")


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    """df with t (the text, null as empty), tkey and tlen, which tell distinct texts apart."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({"t": t, "tkey": F.xxhash64(t), "tlen": F.octet_length(t)})


def repeated_ranges(texts: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """(tkey, tlen, ranges array<struct<lo,hi>>) of each distinct text with repeats; texts has t, tkey, tlen.

    Repeats are of `length` bytes and more, and of `words` words and more in any number of bytes.
    """
    if not 1 <= length < 1 << 15:
        raise ValueError("length is 1 to 32767 bytes")
    ensure_checkpoint_dir(texts.sparkSession)
    starts = F.col("shape").bitwiseAND(F.lit(0xFFFF))
    runs = stored(_runs(texts, length))
    # Written, so that the join below reads two plain shuffles, of which Spark may split a hot anchor's.
    classes = runs.groupBy("anchor").count().where("count >= 2").select("anchor").checkpoint()
    hits = runs.join(classes, "anchor").checkpoint()
    spans = hits.groupBy("anchor", "span").agg(F.least(F.count("*"), F.lit(2)).alias("w"), F.min(F.struct("tkey", "tlen", "lo", "shape")).alias("r")).select("anchor", "span", "w", "r.*").checkpoint()
    twice = hits.join(spans.where("w >= 2").select("anchor", "span"), ["anchor", "span"])
    whole = twice.select("tkey", "tlen", "lo", (F.col("lo") + starts + (length - 1)).alias("hi"))

    weight = spans.groupBy("anchor").agg(F.sum(starts + (length - 1)).alias("bytes"), F.count("*").alias("n")).where("n > 1").drop("n")
    total = weight.agg(F.sum("bytes"), F.max("bytes")).first()
    groups = max(1, -(-(total[0] or 0) // TARGET_BYTES))
    sized = spans.join(weight, "anchor").withColumn("g", F.when(F.col("bytes") <= GROUP_BYTES, F.pmod(F.xxhash64("anchor"), F.lit(groups))))
    asked = sized.groupBy("tkey", "tlen").agg(F.collect_list(F.struct("lo", "shape", "w", "g", "anchor")).alias("asked"))
    pieces = _cut_pieces(texts.join(asked, ["tkey", "tlen"]).select("tkey", "tlen", "t", "asked"), length)
    out = whole.unionByName(_merged("g", pieces.where("g is not null"), length))
    if (total[1] or 0) > GROUP_BYTES:
        out = out.unionByName(_counted(pieces.where("g is null"), length))
    if words:
        out = out.unionByName(_short_passages(texts, words, length))
    return out.groupBy("tkey", "tlen").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _cut_pieces(rows: DataFrame, length: int) -> DataFrame:
    """(g, tkey, tlen, lo, w, anchor, place, piece) from texts with the pieces asked of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for x in slices(batches):
            out = []
            for key, size, text, asked in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if (key, size) == last:  # a copy of the text before
                    continue
                last = (key, size)
                raw = text.encode()
                out += [(a["g"], key, size, a["lo"], a["w"], a["anchor"], a["shape"] >> 16, raw[a["lo"] : a["lo"] + (a["shape"] & 0xFFFF) + length - 1]) for a in asked]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["g", "tkey", "tlen", "lo", "w", "anchor", "place", "piece"])

    return rows.mapInArrow(run, "g long, tkey long, tlen int, lo long, w long, anchor long, place int, piece binary")


def _join_ranges(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal disjoint ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for r in ranges for e in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal_digests(df: DataFrame, id_col: str, text_col: str, length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, text) for each row.

    n_bytes is the size of the whole text, kept_sha256 the digest of the bytes that stay and text is what
    stays, without characters that a removed run cuts through. Null texts count as empty and texts shorter
    than `length` have no repeats. Repeated rows stay, each losing what the copies share. Null ids stay. Only the two named columns are read, so others cannot
    clash. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = keyed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "t", "tkey", "tlen")
    ranges = repeated_ranges(texts, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            size, gone, many, sha, left = [], [], [], [], []
            for text, asked in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                raw, spans = text.encode(), _join_ranges(asked)
                kept = _kept(raw, spans) if spans else raw
                size.append(len(raw))
                gone.append(sum(b - a for a, b in spans))
                many.append(len(spans))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode(errors="ignore") if spans else text)
            cols = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([x.column(0), *cols], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = texts.join(ranges, ["tkey", "tlen"], "left").select("id", "t", "ranges")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(df: DataFrame, text_col: str, length: int = 400, words: int | None = None) -> DataFrame:
    """df with the repeats taken out of the text column; a character cut through goes as a whole.

    Repeats are of `length` bytes and more, and of `words` words and more in any number of bytes.

    Rows, their other columns and null texts stay as they are. A text that is all repeat becomes empty.
    """
    texts = keyed(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text").select("row", "t", "tkey", "tlen")
    ranges = repeated_ranges(texts.select("t", "tkey", "tlen"), length, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            row, out = x.column(0), []
            was = pc.struct_field(row, text_col).to_pylist()
            for old, asked in zip(was, x.column(1).to_pylist(), strict=True):
                spans = _join_ranges(asked)
                out.append(_kept(old.encode(), spans).decode(errors="ignore") if spans else old)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if f.name == text_col else pc.struct_field(row, f.name) for f in row.type], names=[f.name for f in row.type])

    joined = texts.join(ranges, ["tkey", "tlen"], "left").select("row", "ranges")
    return joined.mapInArrow(run, df.schema)
