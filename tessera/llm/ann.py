"""Approximate nearest neighbours: an NN-descent graph and greedy search in it.

Equal vectors are one node with its smallest ids. Nodes are dealt by contents into shards of about
SHARD_ROWS, so a shard's vectors and graph fit in a task whatever the table's size. The graph starts
from neighbours on a few random lines. Each round of NN-descent joins every node's neighbours, in both
directions, with their neighbours in turn, scores what the join brings, and keeps each node's best;
rounds end when few neighbours change. A query walks each shard's graph greedily from a few entry
nodes, always expanding the best node not yet expanded among the BEAM best, and the shards' answers
are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import matrix, meet
from .topk import usable

SHARD_ROWS = 8192
#: Neighbours that a node keeps, and reverse neighbours that a round looks at.
DEGREE = 24
ROUNDS = 6
#: A round that changes fewer of all neighbours ends the descent.
LEAST_CHANGE = 0.01
#: Random lines of the start, and neighbours taken on either side.
LINES, SIDE = 6, 3
BEAM = 160
ENTRIES = 24


def _usable_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part; v keeps its components as they are, in double precision."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    wide = x.schema["v"].dataType.elementType.typeName() != "float"
    if wide:
        x = x.withColumn("v", F.transform("v", lambda c: c.cast("double")))
    return x.where(F.exists("v", lambda c: c != 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision, all divided by the largest component; the order of inner products stays."""
    top = np.abs(x).max() if x.size else 0
    return (x / top if top > 0 else x).astype("f4")


def nodes(df: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(block, node, v, ids): distinct usable vectors with their `keep` smallest ids, numbered in their shard.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part.
    """
    x = _usable_rows(df, id_col, vector_col)
    # The smallest ids of a vector in two steps, so that no task takes a whole group of copies.
    x = x.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("r") <= keep)
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    x = x.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).checkpoint()
    n = max(1, -(-x.count() // SHARD_ROWS))
    x = x.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    number = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("v"), "v")) - 1
    return x.select("block", number.alias("node"), "v", "ids").checkpoint()


def _vectors(_: int, rows: pa.Table) -> np.ndarray:
    out = matrix(rows["v"].combine_chunks(), "f8")
    return _scaled(out[np.argsort(rows["node"].to_numpy())])


def _best(x: np.ndarray, node: int, among: np.ndarray, degree: int) -> np.ndarray:
    among = among[among != node]
    score = x[among] @ x[node]
    if len(among) > degree:
        at = np.argpartition(-score, degree - 1)[:degree]
        among, score = among[at], score[at]
    return among[np.argsort(-score, kind="stable")]


def _lists(node: np.ndarray, near: list[np.ndarray], fresh: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(near, pa.list_(pa.int32())), pa.array(fresh, pa.int32())], names=["node", "near", "fresh"])


def graph(table: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(block, node, near, fresh): each node's neighbours by inner product, best first."""
    held = table.select("block", "node", "v", F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("array<int>").alias("old"))
    schema = "block int, node int, near array<int>, fresh int"

    def with_block(block: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * rows.num_rows, pa.int32()), *rows.columns], names=["block", "node", "near", "fresh"])

    def lines(block: int, rows: pa.Table) -> tuple[int, np.ndarray, list[np.ndarray]]:
        x = _vectors(block, rows)
        rng = np.random.default_rng(block)
        return block, x, [np.argsort(x @ rng.standard_normal(x.shape[1]).astype("f4"), kind="stable") for _ in range(LINES)]

    def start(state: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        block, x, orders = state
        n = len(x)
        place = [np.argsort(o, kind="stable") for o in orders]
        who = asked.column("node").to_numpy()
        near = []
        for v in who:
            among = np.concatenate([o[np.arange(max(p[v] - SIDE, 0), min(p[v] + SIDE + 1, n))] for o, p in zip(orders, place, strict=True)])
            near.append(_best(x, v, np.unique(among), degree))
        return with_block(block, _lists(who, near, [len(k) for k in near]))

    asked = table.select("block", "node", F.lit(None).alias("v"), F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("array<int>").alias("old"))
    now = meet(held, asked, schema, lines, start).checkpoint()

    def vectors(block: int, rows: pa.Table) -> tuple[int, np.ndarray]:
        return block, _vectors(block, rows)

    def score(state: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        block, x = state
        who, near, fresh = rows.column("node").to_numpy(), [], []
        for v, met, old in zip(who, rows.column("near"), rows.column("old"), strict=True):
            was = old.values.to_numpy()
            best = _best(x, v, np.unique(np.concatenate([met.values.to_numpy(), was])), degree)
            near.append(best)
            fresh.append(len(np.setdiff1d(best, was)))
        return with_block(block, _lists(who, near, fresh))

    for _ in range(rounds):
        # Neighbours of a node are those it lists and, up to its degree, those that list it.
        ahead = now.select("block", "node", F.explode("near").alias("by"))
        back = ahead.select("block", F.col("by").alias("node"), F.col("node").alias("by"))
        pick = Window.partitionBy("block", "node").orderBy(F.xxhash64("node", "by"))
        back = back.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= degree).drop("r")
        both = ahead.union(back).distinct()
        lists = now.select("block", F.col("node").alias("by"), F.col("near").alias("near_by"))
        met = both.join(lists, ["block", "by"]).groupBy("block", "node").agg(F.flatten(F.collect_list(F.concat("near_by", F.array("by")))).alias("near"))
        ask = met.join(now.select("block", "node", F.col("near").alias("old")), ["block", "node"]).select("block", "node", F.lit(None).alias("v"), F.array_distinct("near").alias("near"), "old")
        # A node that neither lists nor is listed stands alone in its shard and keeps its empty list.
        alone = now.where(F.size("near") == 0).withColumn("fresh", F.lit(0))
        now = meet(held, ask, schema, vectors, score).unionByName(alone).checkpoint()
        changed = now.agg(F.sum("fresh") / F.greatest(F.sum(F.size("near")), F.lit(1))).first()[0] or 0
        if changed < LEAST_CHANGE:
            break
    return now


def greedy(x: np.ndarray, near: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the k best that each query meets on its walk, -1 where it met fewer.

    near has a row of neighbours a node, padded with the node itself. All queries walk together, a step
    each, and a query rests when the best `beam` nodes that it knows are all expanded.
    """
    n, many = len(x), len(queries)
    entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))
    beam = min(max(beam, k), n)
    node = np.full((many, beam), -1)
    score = np.full((many, beam), -np.inf, "f4")
    done = np.ones((many, beam), bool)
    seen = np.zeros((many, n), bool)

    def take(rows: np.ndarray, fresh: np.ndarray) -> None:
        """Nodes that rows meet, -1 for none, each once a row."""
        s = np.einsum("qmd,qd->qm", x[fresh], queries[rows], optimize=True)
        s[fresh < 0] = -np.inf
        ids = np.concatenate([node[rows], fresh], 1)
        both = np.concatenate([score[rows], s], 1)
        over = np.concatenate([done[rows], fresh < 0], 1)
        at = np.argpartition(-both, beam - 1, 1)[:, :beam]
        node[rows], score[rows], done[rows] = (np.take_along_axis(z, at, 1) for z in (ids, both, over))

    rows = np.arange(many)
    seen[:, entries] = True
    take(rows, np.tile(entries, (many, 1)))
    while len(rows):
        open_score = np.where(done[rows], -np.inf, score[rows])
        at = open_score.argmax(1)
        going = open_score[np.arange(len(rows)), at] > -np.inf
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        done[rows, at] = True
        fresh = near[node[rows, at]].copy()
        old = seen[rows[:, None], fresh]
        seen[rows[:, None], fresh] = True
        fresh[old] = -1
        take(rows, fresh)
    order = np.argsort(-score, 1, kind="stable")[:, : min(k, beam)]
    return np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)


def search(table: DataFrame, links: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each query, by inner product in double precision.

    table and links come from nodes(..., keep=k + 1) and graph(). A node with the query's id leaves that
    id out. Of several queries of one id the one with the smallest vector is asked. Queries with unusable
    vectors get no rows. Ties go to the smaller id.
    """
    q = _usable_rows(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    blocks = table.select("block").distinct()
    held = table.join(links.select("block", "node", "near"), ["block", "node"]).select("block", F.lit(None).cast("long").alias("id"), "node", "v", "near", "ids")
    # One row for each shard: the stated query set against all shards.
    asked = q.join(F.broadcast(blocks.agg(F.collect_set("block").alias("all")))).select(F.explode("all").alias("block"), "id", F.lit(0).alias("node"), "v", F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("array<long>").alias("ids"))

    def settle(block: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        order = np.argsort(rows["node"].to_numpy())
        x = matrix(rows["v"].combine_chunks(), "f8")[order]
        lists, ids = rows["near"].combine_chunks(), rows["ids"].combine_chunks()
        near = np.tile(np.arange(len(x))[:, None], (1, max([1, *(len(lists[int(i)]) for i in order)])))
        for v, i in enumerate(order.tolist()):
            one = lists[i].values.to_numpy()
            near[v, : len(one)] = one
        return x, _scaled(x), near, [ids[int(i)].values.to_numpy() for i in order]

    def answer(state: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        x, walk, near, ids = state
        who, v = rows.column("id").to_numpy(), matrix(rows.column("v"), "f8")
        out_q, out_i, out_s = [], [], []
        for a in range(0, len(who), 256):
            found, _ = greedy(walk, near, _scaled(v[a : a + 256]), k + 1, beam)
            for me, vec, at in zip(who[a : a + 256].tolist(), v[a : a + 256], found, strict=True):
                at = at[at >= 0]
                exact = (x[at] * vec).sum(1)
                for node, s in zip(at.tolist(), exact.tolist(), strict=True):
                    mine = [i for i in ids[node].tolist() if i != me][:k]
                    out_q += [me] * len(mine)
                    out_i += mine
                    out_s += [s] * len(mine)
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "id", "score"])

    met = meet(held, asked, "query_id long, id long, score double", settle, answer)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(query_id, rank, id, score): the index over all of df is built, then asked for the queries' k nearest.

    Rows with a null id and vectors that are null, zero or hold null or non-finite components take no part,
    neither as candidates nor as queries. Repeated rows and equal vectors are one node with all its ids
    that can be asked for; ties go to the smaller id. Scores are inner products of the vectors as given, in
    double precision. Only the two named columns are read; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    table = nodes(df, id_col, vector_col, k + 1)
    return search(table, graph(table), queries, id_col, vector_col, k)
