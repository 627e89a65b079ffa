"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits
share at least five of the eight. The index posts each distinct fingerprint under positional bytes;
for each pair that meets in a posting, the shared positional bytes are tallied first, pairs with fewer
than the guaranteed five are let go by their count, and only the rest are verified bit by bit.

A posting of one byte would hold a 256th of all fingerprints. Of five shared positions, three lie in
the same half (positions 0-3 or 4-7), so postings here are keyed by three positional bytes of one
half: eight postings for each fingerprint, 2^24 keys each, and no linked pair is lost. Equal
fingerprints are one entry with its smallest id, so large groups of copies never enter the index.
A posting is met in blocks of BLOCK fingerprints and answers with links to the smallest of each
linked set only, never with all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import ensure_checkpoint_dir
from .textbytes import steps, text_buffer
from .xxh64 import xxh64_ranges

#: Fingerprints of one posting that are compared at once.
BLOCK = 2048

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A byte's bits, each in a byte of its own: up to 255 of these words add without carry.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 3) -> np.ndarray:
    """The fingerprint of each text: majority of each bit over the XXH64 (seed 42) of its word shingles."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    for a, b in steps(offsets):
        out[a:b] = _slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
    return out


def _slice(raw: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(raw):
        return out
    # One space after each text keeps words of neighbours apart.
    text = np.full(len(raw) + n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    text[np.arange(len(raw)) + doc] = _LOWER[raw]
    space = _SPACES[text]
    # Runs of separators become one space.
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    packed = np.zeros(int(keep.sum()) + 8, np.uint8)
    packed[:-8] = np.where(space[keep], 0x20, text[keep])
    owner_at = np.repeat(np.arange(n), np.diff(offsets) + 1)[keep]
    gap = packed[:-8] == 0x20
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    if not len(starts):
        return out
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    owner = owner_at[starts]
    count = np.bincount(owner, minlength=n)
    first = np.r_[0, np.cumsum(count)[:-1]]
    shingles = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    rows = np.repeat(np.arange(n), shingles)
    nth = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(shingles)[:-1]], shingles)
    lo = first[rows] + nth
    hi = np.minimum(lo + words, first[rows] + count[rows]) - 1
    h = xxh64_ranges(packed, starts[lo], ends[hi] - starts[lo])
    octets = h.view(np.uint8).reshape(-1, 8)
    # Partial sums over at most 255 shingles of one text, then over the text.
    cuts = np.flatnonzero(nth % 255 == 0)
    of = rows[cuts]
    bits = np.zeros((n, 64), np.int64)
    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for k in range(8):
        part = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[of[edge], 8 * k : 8 * k + 8] = np.add.reduceat(part, edge, axis=0)
    major = bits * 2 > shingles[:, None]
    out[:] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(df: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id_col, fp long) for each row. Null or empty text: fingerprint zero."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = fingerprints(*text_buffer(x.column(1)), words)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def tallied(octets: np.ndarray, others: np.ndarray, need: int) -> np.ndarray:
    """Count filtering: whether each of octets (n x 8) shares `need` positional bytes or more with each of others (m x 8)."""
    tally = np.zeros((len(octets), len(others)), np.uint8)
    for p in range(8):
        tally += octets[:, p, None] == others[None, :, p]
    return tally >= need


def _octets(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)


def _links_of_run(fp: np.ndarray, most: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links that join every linked set of one posting, met block against block."""
    root = np.arange(len(fp))
    octets = _octets(fp)
    for a in range(0, len(fp), BLOCK):
        for b in range(a, len(fp), BLOCK):
            mine, other = slice(a, a + BLOCK), slice(b, b + BLOCK)
            if (root[mine] == root[a]).all() and (root[other] == root[a]).all():
                continue
            retained = tallied(octets[mine], octets[other], need)
            i, j = np.nonzero(np.triu(retained, 1) if a == b else retained)
            near = np.bitwise_count(fp[mine][i] ^ fp[other][j]) <= most
            i, j = i[near] + a, j[near] + b
            while True:
                ri, rj = root[i], root[j]
                if (ri == rj).all():
                    break
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while not np.array_equal(up := root[root], root):
                    root = up
    child = np.flatnonzero(root != np.arange(len(fp)))
    yield fp[root[child]], fp[child]


def _links(key: np.ndarray, fp: np.ndarray, most: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal keys; runs of up to 8 are met by shifted comparison, all at once."""
    if not len(key):
        return
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    small = np.repeat(size <= 8, size)
    k, f = key[small], fp[small]
    octets = _octets(f)
    for shift in range(1, 8):
        if len(k) <= shift:
            break
        at = np.flatnonzero(k[shift:] == k[:-shift])
        at = at[(octets[at] == octets[at + shift]).sum(1) >= need]
        at = at[np.bitwise_count(f[at] ^ f[at + shift]) <= most]
        if len(at):
            yield f[at], f[at + shift]
    for h, m in zip(head[size > 8], size[size > 8], strict=True):
        yield from _links_of_run(fp[h : h + m], most, need)


def near_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a long, b long): links among the distinct values of column fp that join all values at most `most` bits apart.

    Every linked set is connected by the rows returned; pairs in it that follow from others may be absent.
    """
    need = 8 - most
    if most != 3:
        raise ValueError("postings of three bytes of one half fit three differing bits")
    post = [
        F.struct(
            F.lit(16 * half + drop).alias("slot"),
            sum((F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) * F.lit(1 << (8 * i)) for i, p in enumerate(kept)), F.lit(0)).cast("long").alias("octets"),
        )
        for half in (0, 1)
        for drop, kept in enumerate(combinations(range(4 * half, 4 * half + 4), 3))
    ]
    rows = prints.select("fp", F.explode(F.array(*post)).alias("p")).select((F.col("p.slot").cast("long") * (1 << 24) + F.col("p.octets")).alias("k"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_k, hold_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def met(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _links(k, f, most, need):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for x in batches:
            k = np.concatenate([hold_k, x.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([hold_f, x.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            yield from met(k[:last], f[:last])
            hold_k, hold_f = k[last:].copy(), f[last:].copy()
        yield from met(hold_k, hold_f)

    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "k").sortWithinPartitions("k", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 3, most: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row: its 16-digit fingerprint and the smallest id reachable by links.

    Rows link when their fingerprints differ in at most `most` bits. Null, empty and wordless texts have
    fingerprint zero and are linked like any other. Repeated rows stay; a null id stays and takes part,
    but is no group's smallest id unless all its ids are null. Only the two named columns are read, so
    further columns cannot clash. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    prints = with_fingerprint(df, id_col, text_col, words).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    member = components(near_links(distinct.select("fp"), most), "a", "b")
    rooted = distinct.join(member, distinct.fp == member.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
