"""Near-duplicates by similarity of word shingles, found through two indexes and verified exactly.

The first index is the byte-position index of SimHash fingerprints with count filtering. It joins most of
each group cheaply: each posting answers with one near partner for each of its texts, and each text is
verified against one of those. Fingerprints of three differing bits miss pairs that are similar enough.

The second index is complete. Under one order of all shingles, two sets of Jaccard similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each. Texts meet under those; every pair that is not
in one group yet and whose sizes and places allow the similarity is a candidate. The order puts
shingles that are frequent in a sample last, which keeps postings short; any order gives the same links.
Candidates of a large group of near copies grow with its square, so the index is first asked for one
partner of each text, a few times over with the groups found so far. Most of a group is then joined, and only
candidates of the texts that had a partner, between groups, come as pairs.

Candidates are verified in two steps, both exact. Sets that differ in d shingles have parity maps that differ
in d bits at most, so a pair whose maps differ in more bits than the similarity allows is let go. The rest
is a link if the sets of 64-bit shingle hashes have the wanted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import ensure_checkpoint_dir, stored
from .simhash import _LOWER, _SPACES, _SPREAD, _octets, tallied
from .textbytes import slices, steps, text_buffer
from .xxh64 import xxh64_ranges

SEEDS = 2
MOST_BITS, LEAST_BYTES = 3, 5
#: One text of SAMPLE is counted for the order of shingles; those met in SEEN of them or more, FREQUENT at most, go last.
SAMPLE, SEEN, FREQUENT = 16, 3, 200_000
#: Runs of a shingle with up to so many texts are met by shifted comparison, all at once.
SHORT_RUN = 32
#: Texts of one posting that are compared at once with as many others.
BLOCK = 512
#: Bits of a set's parity map.
MAP_BITS = 2048
#: Wanted postings of one task of the complete index.
TASK_POSTINGS = 2_000_000
#: Asked texts of a verification that are sent to all tasks, at 8 bytes each; more are joined by a shuffle of the texts.
SENT_NODES = 2_000_000
#: Pairs that a task gathers before it gives the distinct ones on.
HELD_PAIRS = 1 << 18
#: Times that the complete index is asked for one partner a text before it is asked for all pairs that are left.
PARTNER_ROUNDS = 2

_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * s) & (2**64 - 1)) for s in range(1, SEEDS + 1)]


def _mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = h ^ seed
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word, lower-cased in A-Z, in order."""
    n = len(offsets) - 1
    text = np.full(len(raw) + n + 8, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    text[np.arange(len(raw)) + doc] = _LOWER[raw]
    gap = _SPACES[text[:-8]]
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    owner = np.searchsorted(offsets[1:] + np.arange(1, n + 1), starts, "right")
    return owner, xxh64_ranges(text, starts, ends - starts)


def _prints(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """SEEDS fingerprints of each of n texts over its distinct words; zeros without words."""
    out = np.zeros((n, SEEDS), np.uint64)
    # Words of 44 bits behind the text's number: one sort finds the distinct ones of every text.
    bits = np.uint64(20)
    key = np.unique((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    of = (key >> (np.uint64(64) - bits)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[head, len(of)])
    nth = np.arange(len(of)) - np.repeat(head, size)
    cuts = np.flatnonzero(nth % 255 == 0)
    edge = np.flatnonzero(np.r_[True, of[cuts][1:] != of[cuts][:-1]])
    word = key << bits
    for s, seed in enumerate(_SEEDS):
        octets = _mixed(word, seed).view(np.uint8).reshape(-1, 8)
        total = np.zeros((len(head), 64), np.int64)
        for k in range(8):
            part = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
            total[:, 8 * k : 8 * k + 8] = np.add.reduceat(part, edge, axis=0)
        out[of[head], s] = np.packbits(total * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _chained(h: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of so many words."""
    x = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        x = _mixed(x * np.uint64(31) + h[k : len(h) - words + 1 + k], _SEEDS[0])
    return x


def _sets(owner: np.ndarray, h: np.ndarray, n: int, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text has its whole sequence."""
    out = [np.zeros(0, np.uint64)] * n
    count = np.bincount(owner, minlength=n)
    first = np.r_[0, np.cumsum(count)[:-1]]
    x = _chained(h, words) if len(h) >= words else h[:0]
    for d in np.flatnonzero(count).tolist():
        lo, m = first[d], count[d]
        out[d] = np.unique(x[lo : lo + m - words + 1] if m >= words else _chained(h[lo : lo + m], m))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    out: list[np.ndarray] = []
    for a, b in steps(offsets):
        out += _sets(*_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a, words)
    return out


def parity_maps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MAP_BITS / 8 bytes a set: a bit is 1 if an odd number of its shingles fall on it."""
    at = np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(MAP_BITS - 1)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(row * MAP_BITS + at.astype(np.int64), minlength=len(sets) * MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), MAP_BITS), axis=1)


def shingle_order(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the shingles that are frequent in a sample of texts (node, t), by key; they only order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            k, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(*text_buffer(x.column(1)), words)]) >> np.uint64(32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["k", "n"])

    some = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(count, "k long, n long")
    rows = some.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "k").limit(FREQUENT).collect()
    k, n = np.array([r.k for r in rows], np.uint32), np.array([r.n for r in rows], np.int64)
    by = np.argsort(k)
    return k[by], n[by]


def _first(s: np.ndarray, order: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The keys, upper halves of the hashes, of a sorted set's shingles that come first in the order; a similar set has one of them first, too."""
    k, n = order
    m = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
    key = (s >> np.uint64(32)).astype(np.uint32)
    if not len(k):
        return key[:m]
    at = np.minimum(np.searchsorted(k, key), len(k) - 1)
    return key[np.argsort(np.where(k[at] == key, n[at], 0), kind="stable")[:m]]


def sketches(texts: DataFrame, words: int, least: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, fps, size, firsts, bits) of each distinct text (node, t) with words: fingerprints, shingles, first keys, parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for x in slices(batches, 2048):
            # Copies within a task are one node.
            x = x.filter(pa.array([not (k in met or met.add(k)) for k in x.column(0).to_pylist()], pa.bool_()))
            data, offsets = text_buffer(x.column(1))
            node = x.column(0).to_numpy()
            for a, b in steps(offsets):
                owner, h = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                sets = _sets(owner, h, b - a, words)
                some = np.flatnonzero([len(s) > 0 for s in sets])
                mine = [sets[i] for i in some.tolist()]
                fps = pa.FixedSizeListArray.from_arrays(pa.array(_prints(owner, h, b - a)[some].view(np.int64).ravel()), SEEDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[a:b][some]), fps, pa.array([len(s) for s in mine], pa.int32()), pa.array([_first(s, order, least).tobytes() for s in mine], pa.binary()), pa.array([m.tobytes() for m in parity_maps(mine)], pa.binary())],
                    names=["node", "fps", "size", "firsts", "bits"],
                )

    rows = texts.mapInArrow(run, "node long, fps array<long>, size int, firsts binary, bits binary")
    return rows.groupBy("node").agg(F.first("fps").alias("fps"), F.first("size").alias("size"), F.first("firsts").alias("firsts"), F.first("bits").alias("bits"))


def _partners(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of one posting: for each j that has any, one i of a near fingerprint, by count filtering and bits."""
    octets = _octets(fp)
    found_i, found_j = [], []
    for b in range(0, len(fp), BLOCK):
        left = np.arange(b, min(b + BLOCK, len(fp)))
        for a in range(0, b + 1, BLOCK):
            rows = np.arange(a, min(a + BLOCK, len(fp)))
            near = tallied(octets[rows], octets[left], LEAST_BYTES)
            near &= rows[:, None] < left[None, :]
            i, j = np.nonzero(near)
            ok = np.bitwise_count(fp[rows[i]] ^ fp[left[j]]) <= MOST_BITS
            j, first = np.unique(j[ok], return_index=True)
            found_i.append(rows[i[ok][first]])
            found_j.append(left[j])
            left = np.delete(left, j)
            if not len(left):
                break
    return np.concatenate(found_i), np.concatenate(found_j)


def candidate_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of nodes that are near in the byte-position index, one partner a node and posting; prints has node and fps, an array of SEEDS longs."""
    post = [
        F.struct(F.lit((s * 2 + half) * 4 + drop).cast("long").alias("slot"), F.get("fps", F.lit(s)).alias("fp"), sum((F.shiftrightunsigned(F.get("fps", F.lit(s)), 8 * p).bitwiseAND(F.lit(255)) * F.lit(1 << (8 * i)) for i, p in enumerate(kept)), F.lit(0)).cast("long").alias("octets"))
        for s in range(SEEDS)
        for half in (0, 1)
        for drop, kept in enumerate(combinations(range(4 * half, 4 * half + 4), 3))
    ]
    rows = prints.select("node", F.explode(F.array(*post)).alias("p")).select((F.col("p.slot") * (1 << 24) + F.col("p.octets")).alias("k"), "p.fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def met(k: np.ndarray, f: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[head, len(k)])
            pairs = [np.zeros((0, 2), np.int64)]
            for h, m in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                i, j = _partners(f[h : h + m])
                pairs.append(np.column_stack([v[h + i], v[h + j]]))
            both = np.concatenate(pairs)
            if len(both):
                yield _pair_rows(both[:, 0], both[:, 1])

        for x in batches:
            now = [np.concatenate([old, x.column(i).to_numpy(zero_copy_only=False).view(old.dtype)]) for i, old in enumerate(hold)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            yield from met(*(c[:last] for c in now))
            hold = [c[last:].copy() for c in now]
        yield from met(*hold)

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k").sortWithinPartitions("k", "node").mapInArrow(run, "a long, b long").distinct()


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller node first."""
    both = np.unique(np.rec.fromarrays([np.minimum(a, b), np.maximum(a, b)]))
    return pa.RecordBatch.from_arrays([pa.array(both.f0.copy()), pa.array(both.f1.copy())], names=["a", "b"])


def _may_be_alike(size: np.ndarray, rest: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether sets i and j, not in one group, can be similar if the shingle they meet under is the first that they share."""
    a, b = size[i], size[j]
    return (root[i] != root[j]) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9) & (np.minimum(rest[i], rest[j]) * (1 + least) >= least * (a + b) - 1e-9)


def _pairs_of_shingles(k: np.ndarray, size: np.ndarray, rest: np.ndarray, root: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs that meet in a run of equal k and may be similar; long runs are met block against block."""
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    count = np.diff(np.r_[head, len(k)])
    length = np.repeat(count, count)
    left = length - (np.arange(len(k)) - np.repeat(head, count))
    at = np.flatnonzero((length <= SHORT_RUN) & (left > 1))
    shift = 1
    while len(at):
        ok = _may_be_alike(size, rest, root, at, at + shift, least)
        yield at[ok], at[ok] + shift
        shift += 1
        at = at[left[at] > shift]
    for h, m in zip(head[count > SHORT_RUN].tolist(), count[count > SHORT_RUN].tolist(), strict=True):
        if (root[h : h + m] == root[h]).all():
            continue
        run = h + np.argsort(size[h : h + m], kind="stable")
        for a in range(0, m, BLOCK):
            for b in range(a, m, BLOCK):
                u, v = run[a : a + BLOCK], run[b : b + BLOCK]
                if size[u[-1]] < least * size[v[0]] - 1e-9:
                    break
                near = _may_be_alike(size, rest, root, u[:, None], v[None, :], least)
                i, j = np.nonzero(np.triu(near, 1) if a == b else near)
                yield u[i], v[j]


def _maps_allow(maps: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the parity maps of sets i and j differ in no more bits than sets of similarity `least` do."""
    differ = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(maps[i[a : a + BLOCK]] ^ maps[j[a : a + BLOCK]]).sum(1, dtype=np.int64) for a in range(0, len(i), BLOCK))])
    return differ * (1 + least) <= (1 - least) * (size[i].astype(np.int64) + size[j]) + 1e-6


def complete_pairs(sketched: DataFrame, groups: DataFrame, least: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): every pair of texts of similarity `least` or more that groups (node, root) do not join, and others."""
    return _met(sketched, groups, least, order, None).where("a <> b").distinct()


def partners(sketched: DataFrame, groups: DataFrame, least: float, order: tuple[np.ndarray, np.ndarray], nth: int) -> DataFrame:
    """(node, by): for each text of a pair that complete_pairs has one partner, of a near fingerprint if there is one.

    Of partners about as near all texts prefer the same ones, others in each round `nth`, so that a group of
    near copies gathers around a few. There is a row for each text that has a candidate, whatever the group.
    """
    found = _met(sketched, groups, least, order, nth).groupBy("a").agg(F.min_by("b", "far").alias("by"))
    return found.select(F.col("a").alias("node"), "by")


class _Best:
    """The partner of the lowest key for each text of a task."""

    def __init__(self, node: np.ndarray, fp: np.ndarray, nth: int) -> None:
        self.node, self.fp = node, fp
        self.liked = _mixed(node.view(np.uint64), np.uint64(nth)) >> np.uint64(5)
        self.far = np.full(len(node), np.iinfo(np.int64).max, np.int64)
        self.by = np.zeros(len(node), np.int64)

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.node[i] != self.node[j]
        i, j = i[apart], j[apart]
        step = (np.bitwise_count(self.fp[i] ^ self.fp[j]) >> 3).astype(np.uint64) << np.uint64(59)
        for at, other in ((i, j), (j, i)):
            far = (step | self.liked[other]).view(np.int64)
            by = np.lexsort((far, at))
            first = by[np.flatnonzero(np.diff(at[by], prepend=-1))]
            first = first[far[first] < self.far[at[first]]]
            self.far[at[first]], self.by[at[first]] = far[first], self.node[other[first]]

    def rows(self) -> pa.RecordBatch:
        have = self.far < np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(c[have]) for c in (self.node, self.by, self.far)], names=["a", "b", "far"])


def _met(sketched: DataFrame, groups: DataFrame, least: float, order: tuple[np.ndarray, np.ndarray], nth_round: int | None) -> DataFrame:
    """(a, b) of all that meet in the complete index and may be alike, or (a, b, far) with a task's best b for each a.

    Postings travel packed: a batch sends each task one row with all that it posts there. Texts posted under
    keys of the order, the frequent ones, bring their parity maps, so that pairs of a long posting are let go
    where they meet.
    """
    n = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sketched.agg(F.sum(F.length("firsts"))).first()[0] or 0
    parts = max(n, -(-total // (4 * TASK_POSTINGS)))
    one_each = nth_round is not None
    rooted = sketched.select("node", "size", "firsts", "bits", F.get("fps", F.lit(0)).alias("fp")).join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "firsts", "bits", "fp")
    names = ["k", "nth", "of", "node", "root", "size", "mapped", "maps", "fp"]
    # A place beyond 16 bits counts as the last of them, which lets more pairs pass and none go.
    kinds = [np.uint32, np.uint16, np.uint16, np.int64, np.int64, np.int32, np.bool_, np.uint64, np.uint64]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 4096):
            firsts = [np.frombuffer(b, np.uint32) for b in x.column(3).to_pylist()]
            n = np.array([len(b) for b in firsts], np.int64)
            if not len(n):
                continue
            node, root, size = (x.column(i).to_numpy() for i in range(3))
            maps = np.frombuffer(b"".join(x.column(4).to_pylist()), np.uint64).reshape(len(n), -1)
            fp = x.column(5).to_numpy()
            k = np.concatenate(firsts)
            frequent = np.isin(k, order[0])
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            nth = (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)).clip(max=65535).astype(np.uint16)
            part = k % np.uint32(parts)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            out: list[tuple] = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = by[cuts[p] : cuts[p + 1]]
                mine, of = np.unique(doc[at], return_inverse=True)
                mapped = np.zeros(len(mine), bool)
                mapped[of[frequent[at]]] = True
                out.append((p, *(c.tobytes() for c in (k[at], nth[at], of.astype(np.uint16), node[mine], root[mine], size[mine], mapped, maps[mine[mapped]], fp[mine] if one_each else fp[:0]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.binary()) for i in range(len(names) + 1)], names=["p", *names])

    packed = rooted.mapInArrow(post, "p int, " + ", ".join(f"{c} binary" for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in kinds]
        texts = 0
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns[1:]), strict=True):
                one = [np.frombuffer(b, t) for b, t in zip(row, kinds, strict=True)]
                one[2] = one[2].astype(np.int64) + texts
                texts += len(one[3])
                for c, v in zip(held, one, strict=True):
                    c.append(v)
        if not texts:
            return
        k, nth, of, node, root, size, mapped, maps, fp = (np.concatenate(c) for c in held)
        held.clear()
        maps = maps.reshape(-1, MAP_BITS // 64)
        place = np.where(mapped, np.cumsum(mapped) - 1, 0)
        by = np.argsort(k, kind="stable")
        k, nth, of = k[by], nth[by], of[by]
        many = size[of].astype(np.int64)
        pairs, waiting = [], 0
        best = _Best(node, fp, nth_round) if one_each else None
        for i, j in _pairs_of_shingles(k, many, many - nth, root[of], least):
            i, j = of[i], of[j]
            both = mapped[i] & mapped[j]
            at = np.flatnonzero(both)
            both[at] = _maps_allow(maps, size[mapped], place[i[at]], place[j[at]], least)
            both |= ~(mapped[i] & mapped[j])
            if best is not None:
                best.take(i[both], j[both])
            elif both.any():
                pairs.append((node[i[both]], node[j[both]]))
                waiting += int(both.sum())
            if waiting >= HELD_PAIRS:
                yield _pair_rows(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
                pairs, waiting = [], 0
        if pairs:
            yield _pair_rows(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        if best is not None:
            yield best.rows()

    return packed.repartitionById(parts, F.col("p")).mapInArrow(run, "a long, b long, far long" if one_each else "a long, b long")


def map_filtered(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parity maps allow a similarity of `least`."""
    side = lambda c: sketched.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"m{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 4096):
            if not x.num_rows:
                continue
            n = x.num_rows
            size = np.concatenate([x.column(i).to_numpy() for i in (2, 3)])
            maps = np.frombuffer(b"".join(x.column(4).to_pylist() + x.column(5).to_pylist()), np.uint64).reshape(2 * n, -1)
            at = np.arange(n)
            ok = _maps_allow(maps, size, at, at + n, least) & (np.minimum(size[:n], size[n:]) >= least * np.maximum(size[:n], size[n:]) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return met.mapInArrow(run, "a long, b long")


def verified(texts: DataFrame, found: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of texts (node, t) whose shingle sets have Jaccard similarity `least` or more."""
    asked = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().checkpoint()
    if asked.count() <= SENT_NODES:
        asked = F.broadcast(asked)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for x in slices(batches, 2048):
            x = x.filter(pa.array([not (k in met or met.add(k)) for k in x.column(0).to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([s.tobytes() for s in shingle_sets(*text_buffer(x.column(1)), words)], pa.binary())], names=["node", "s"])

    # Both sides of the pairs read one shuffle of these rows, which lies by node.
    have = texts.join(asked, "node").select("node", "t").mapInArrow(sets, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 2048):
            keep = []
            for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both > 0 and both >= least * (len(u) + len(v) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = found.join(have.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(have.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return pairs.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long").checkpoint()


def _one_each(pairs: DataFrame) -> DataFrame:
    """One pair for each node that has a smaller partner."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint()


def similar_groups(df: DataFrame, text_col: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of texts that have links; a text's node is xxhash64 of it, null as empty.

    Links are pairs of different texts whose sets of `words`-word shingles (the whole sequence of a
    shorter text) have Jaccard similarity `least` or more. Wordless texts link to nothing but their equals.
    """
    ensure_checkpoint_dir(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.xxhash64(text).alias("node"), text.alias("t"))
    order = shingle_order(texts, words)
    sketched = stored(sketches(texts, words, least, order))
    links = verified(texts, _one_each(map_filtered(candidate_pairs(sketched), sketched, least)), words, least)
    left = sketched
    for nth in range(PARTNER_ROUNDS):
        groups = components(links, "a", "b").checkpoint()
        near = partners(left, groups, least, order, nth).checkpoint()
        if near.isEmpty():
            return groups
        left = stored(left.join(near.select("node"), "node", "left_semi"))
        pairs = near.select(F.least("node", "by").alias("a"), F.greatest("node", "by").alias("b")).distinct()
        links = links.union(verified(texts, map_filtered(pairs, left, least).checkpoint(), words, least))
    rest = map_filtered(complete_pairs(left, components(links, "a", "b"), least, order), left, least).checkpoint()
    # One pair of each text joins most of what is left; the pairs that are still apart are verified all.
    links = links.union(verified(texts, _one_each(rest), words, least))
    groups = components(links, "a", "b").checkpoint()
    of = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b").checkpoint()
    if apart.isEmpty():
        return groups
    more = verified(texts, apart, words, least)
    return groups if more.isEmpty() else components(links.union(more), "a", "b")


def one_of_each(df: DataFrame, id_col: str, text_col: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """df with one row of each group of equal or similar texts: the one with the smallest id.

    Of rows that share that id and group one stays. Rows with a null id stay only where a group has no
    other. Wordless and null texts are copies only of their equals. Two texts are equal if two 64-bit
    hashes of them agree; of different texts that share the first, one has links and the others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    node, other = F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("other")
    # An id's key is never null, so the join and the numbering before it share one shuffle of the rows.
    key = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("null")).alias("key")
    groups = similar_groups(df, text_col, words, least)
    member = df.select(node, other, F.col(id_col).alias("id")).groupBy("node", "other").agg(F.min("id").alias("id"))
    member = member.withColumn("linked", F.col("other") == F.min("other").over(Window.partitionBy("node")))
    rooted = member.join(groups, "node", "left").select("node", "other", "id", F.coalesce("root", "node").alias("root"), F.when(~F.col("linked"), F.col("other")).alias("apart"))
    first = rooted.groupBy("root", "apart").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "other")).alias("f"))
    chosen = first.select("f.node", "f.other", "f.id").select("node", "other", key("id"))
    # Repeated rows of an id and text are numbered before the join, so that copies go where they are read.
    nth = F.row_number().over(Window.partitionBy("node", "other", "key").orderBy(F.xxhash64("row")))
    x = df.select(F.struct("*").alias("row"), node, other, key(id_col)).withColumn("nth", nth).where("nth = 1")
    return x.join(chosen, ["node", "other", "key"], "left_semi").select("row.*")
