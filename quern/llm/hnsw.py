"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are parted into rings by length, RINGS to a doubling, and rings into shards of up to `shard_rows` distinct vectors,
dealt by hash; so lengths within a shard hardly differ, and vectors of odd length have shards of their own. A shard's graph
links directions: a few flat arrays, levels, and for each layer a fixed number of neighbours for every node. It
is built in batches: a batch searches the graph as it stands and itself, takes neighbours
that are closer to it than to each other, and is linked back, full lists being thinned by the
same rule. Searches run in lock-step too: a beam for each query, all
beams expanded by one matrix operation at a time.

A query walks the graph by inner product, its own length and the shard's largest taken out, so no scale is too large or
small for single precision. What it finds is scored exactly; a query that finds too few in a shard is compared with all of that shard.
Every shard answers every query block; the answers are merged by exact score.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.neighbours import classes, matrix, plain, sound, unit

LINKS, EF_BUILD, STEP = 16, 64, 4
#: Rings of lengths to a doubling.
RINGS = 4
_LONG, _INT = T.LongType(), T.IntegerType()


class Graph:
    """x: vectors; layers: for each level from 0 the neighbours of every node, -1 where there is none; entry: a node of the top layer.

    Near is a small distance or, with `inner`, a large inner product.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int, inner: bool = False):
        self.x, self.layers, self.entry = x, layers, entry
        self.norms = np.zeros(len(x), x.dtype) if inner else np.einsum("ij,ij->i", x, x)

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its ids, less the query's own norm; or -2 times the inner products."""
        return self.norms[ids] - 2 * np.einsum("ijk,ik->ij", self.x[ids], q)

    def beam(self, q: np.ndarray, entry: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of up to ef near nodes of one layer for each query, unsorted, -1 and inf where there are fewer. entry: q x any, -1 for none."""
        links, n = self.layers[level], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, ef), -1, np.int64)
        far = np.full((n, ef), np.inf, np.float32)
        open_ = np.zeros((n, ef), bool)
        entry = entry[:, :ef]
        k = entry.shape[1]
        real = entry >= 0
        ids[:, :k] = entry
        far[:, :k] = np.where(real, self.distances(q, np.maximum(entry, 0)), np.inf)
        open_[:, :k] = real
        np.put_along_axis(seen, np.maximum(entry, 0), True, axis=1)
        active = np.arange(n)
        step = min(STEP, ef)
        while len(active):
            rank = np.where(open_[active], far[active], np.inf)
            best = np.argpartition(rank, step - 1, axis=1)[:, :step]
            chosen = np.isfinite(np.take_along_axis(rank, best, 1))
            alive = chosen.any(axis=1)
            active, best, chosen = active[alive], best[alive], chosen[alive]
            if not len(active):
                break
            own = ids[active]
            near = np.where(chosen[:, :, None], links[np.maximum(np.take_along_axis(own, best, 1), 0)], -1).reshape(len(active), -1)
            flags = open_[active]
            np.put_along_axis(flags, best, False, axis=1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(new)
            seen[active[rows], near[rows, cols]] = True
            dist = np.full(near.shape, np.inf, np.float32)
            dist[rows, cols] = self.norms[near[rows, cols]] - 2 * np.einsum("ij,ij->i", self.x[near[rows, cols]], q[active[rows]])
            both, all_ids, all_open = np.concatenate((far[active], dist), 1), np.concatenate((own, near), 1), np.concatenate((flags, new), 1)
            keep = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            far[active], ids[active], open_[active] = (np.take_along_axis(v, keep, 1) for v in (both, all_ids, all_open))
        ids[~np.isfinite(far)] = -1
        return ids, far

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entries for layer `to`: a narrow beam through the layers above it."""
        entry = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.layers) - 1, to, -1):
            entry = self.beam(q, entry, level, 8)[0]
        return entry

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(q, self.descend(q, 0), 0, ef)


def _spread(x: np.ndarray, own: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Neighbours among candidates, nearest first, leaving out what lies closer to a chosen one than to the node itself; filled up with the nearest left out."""
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    real = (ids >= 0) & np.isfinite(far)
    points = x[np.maximum(ids, 0)]
    norms = np.einsum("ijk,ijk->ij", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    to_own = np.where(real, far + np.einsum("ij,ij->i", x[own], x[own])[:, None], np.inf)
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        blocked = (taken[:, :c] & (between[:, c, :c] < to_own[:, c, None])).any(axis=1)
        taken[:, c] = real[:, c] & ~blocked & (taken[:, :c].sum(axis=1) < most)
    key = np.where(taken, 0, np.where(real, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    pick = np.argsort(key, axis=1)[:, :most]
    out = np.where(np.take_along_axis(real, pick, 1), np.take_along_axis(ids, pick, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link(graph: Graph, level: int, new: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
    """Give the new nodes of a layer their neighbours and link them back."""
    links, x = graph.layers[level], graph.x
    most = links.shape[1]
    chosen = _spread(x, new, ids, far, LINKS)
    links[new, :LINKS] = chosen
    source = np.repeat(new, LINKS)
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 256):
        some, n = nodes[lo : lo + 256], count[lo : lo + 256]
        more = np.full((len(some), n.max()), -1, np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        more[np.repeat(np.arange(len(some)), n), nth] = source[first[lo] : first[lo] + n.sum()]
        all_ = np.concatenate((links[some], more), axis=1)
        all_.sort(axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        full = (all_ >= 0).sum(axis=1) > most
        tight = np.sort(all_, axis=1)[:, ::-1][:, :most]
        links[some[~full]] = np.pad(tight[~full], ((0, 0), (0, most - tight.shape[1])), constant_values=-1)
        if full.any():
            cand = all_[full]
            d = np.where(cand >= 0, graph.distances(x[some[full]], np.maximum(cand, 0)), np.inf)
            links[some[full]] = _spread(x, some[full], cand, d, most)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """The graph of float32 vectors, at least one."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    level[0] = level.max()  # the first node stays the entry
    layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(level.max() + 1)]
    graph = Graph(x, layers, 0)
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + max(1, min(256, done))))
        entry = np.zeros((len(new), 1), np.int64)
        q = x[new]
        inner = graph.norms[new][None, :] - 2 * q @ q.T  # the batch itself
        np.fill_diagonal(inner, np.inf)
        for k in range(len(layers) - 1, -1, -1):
            ids, far = graph.beam(q, entry, k, EF_BUILD if k == 0 else 24)
            here = np.flatnonzero(level[new] >= k)
            if len(here):
                cols = here[np.argsort(inner[np.ix_(here, here)], axis=1)[:, :LINKS]]
                rows = np.take_along_axis(inner[here], cols, 1)
                _link(graph, k, new[here], np.concatenate((ids[here], new[cols]), 1), np.concatenate((far[here], rows), 1))
            entry = ids
        done = new[-1] + 1
    return graph


def search_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = 128, shard_rows: int = 8192, block_rows: int = 16384, key: str = "vec_id", vector: str = "embedding", mask: int = -1
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of `queries`, which are rows of `vectors` too, the k other rows of `vectors` found with the largest inner products.

    Cases: vectors that are null, zero or hold null or non-finite components take no part, all others do, however long or short they are; vectors of each dimension are searched among
    themselves; equal vectors are indexed once and all returned; rows with a query's key but another vector, and further copies of the query's row, are candidates like
    any other row; null keys are candidates and queries too; ties go to the lesser key, null keys last; with fewer than k candidates all are
    returned; repeated query rows are answered each; an empty table gives no rows; further columns are ignored.
    """
    kind = vectors.schema[key].dataType
    result = T.StructType([T.StructField("query_id", kind), T.StructField("rank", _INT), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    with Scratch(vectors.sparkSession) as scratch:
        rows, kinds = classes(vectors, key, vector, scratch, mask)
        rows = rows.where("node IS NOT NULL")
        first = rows.groupBy("node").agg(F.min("id").alias("least"))
        # written as a column, for an expression would be worked out again for each component that is divided by it
        kinds = scratch.keep(kinds.join(first, "node").withColumn("most", F.array_max(F.transform("vector", F.abs))))
        asked = queries.where(sound(F.col(vector))).select(F.col(key).alias("id"), plain(F.col(vector)).alias("vector"))
        asked = asked.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("times"))
        asked = scratch.keep(asked.withColumn("dim", F.size("vector")).withColumn("_q", F.monotonically_increasing_id()))
        found = [scratch.keep(_nearest(kinds.where(F.col("dim") == r["dim"]), asked.where(F.col("dim") == r["dim"]), k, ef, shard_rows, block_rows, r["dim"], kind, scratch)) for r in asked.select("dim").distinct().orderBy("dim").collect()]
        if not found:
            return vectors.sparkSession.createDataFrame([], result)
        # of equal vectors no more than k + 1 keys can matter: the least ones, the query's own among them or not
        order = F.col("id").asc_nulls_last()
        ids = rows.select("node", "id").withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy(order))).where(F.col("_n") <= k + 1)
        ids = scratch.keep(ids.withColumn("_copy", F.row_number().over(W.partitionBy("node", "id").orderBy("_n"))).drop("_n"))
        same = ["query_id", "_q"]
        best = W.partitionBy(*same).orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "node")
        nodes = functools.reduce(DataFrame.unionByName, found).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
        own = (F.col("_copy") == 1) & F.col("own") & F.col("id").eqNullSafe(F.col("query_id"))
        each = nodes.join(ids, "node").where(~own)
        last = W.partitionBy(*same).orderBy(F.desc("score"), order)
        ranked = each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        return lasting(ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def _nearest(kinds: DataFrame, asked: DataFrame, k: int, ef: int, shard_rows: int, block_rows: int, dim: int, key_type: T.DataType, scratch: Scratch) -> DataFrame:
    """query_id, _q (a query row's name), times, node, least (the node's least key), own (whether it is the query's own vector), score: each shard's k + 1 nearest distinct vectors."""
    kinds = kinds.withColumn("ring", _ring(F.col("vector"), F.col("most")))
    sizes = {r["ring"]: -(-r["n"] // shard_rows) for r in kinds.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).orderBy("ring").collect()}  # rows by exponents of doubles: 8,600 at most
    shards, blocks = sum(sizes.values()), max(1, -(-asked.count() // block_rows))
    firsts = [(ring, sum(list(sizes.values())[:i]), n) for i, (ring, n) in enumerate(sizes.items())]
    dealt = kinds.join(F.broadcast(kinds.sparkSession.createDataFrame(firsts, "ring int, first int, n int")), "ring")
    dealt = dealt.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("n"))).cast("int")).drop("ring", "most", "first", "n")
    stored = T.StructType([T.StructField("shard", _INT), T.StructField("node", T.ArrayType(_LONG)), T.StructField("least", T.ArrayType(key_type)), T.StructField("vectors", T.BinaryType()), T.StructField("links", T.ArrayType(T.BinaryType())), T.StructField("entry", _INT)])

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")  # the same graph whenever the shard is built again
        x = matrix(table.column("vector").combine_chunks(), dim)
        graph = build(unit(x).astype(np.float32))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.table(
            [table.column("shard").slice(0, 1).cast(pa.int32()), one(table.column("node").combine_chunks()), one(table.column("least").combine_chunks()), pa.array([x.tobytes()], pa.binary()), pa.array([[a.tobytes() for a in graph.layers]], pa.list_(pa.binary())), pa.array([graph.entry], pa.int32())],
            names=stored.names,
        )

    graphs = scratch.keep(dealt.groupBy("shard").applyInArrow(index, stored))
    block = F.pmod(F.col("_q"), F.lit(blocks)).cast("int")
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = asked.select("id", "vector", "times", "_q").withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1))))).groupBy("shard", "block")
    out = T.StructType([T.StructField("query_id", key_type), T.StructField("_q", _LONG), T.StructField("times", _LONG), T.StructField("node", _LONG), T.StructField("least", key_type), T.StructField("own", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def answer(graphs: pa.Table, asked: pa.Table) -> pa.Table:
        asked, graphs = asked.combine_chunks(), graphs.combine_chunks()
        if not len(graphs) or not len(asked):
            kind = asked.schema.field("id").type
            return pa.table([pa.array([], f) for f in (kind, pa.int64(), pa.int64(), pa.int64(), kind, pa.bool_(), pa.float64())], names=out.names)
        x = np.frombuffer(graphs.column("vectors")[0].as_py()).reshape(-1, dim)
        layers = [np.frombuffer(b, np.int32).reshape(len(x), -1) for b in graphs.column("links")[0].as_py()]
        graph = Graph(_scaled(x), layers, graphs.column("entry")[0].as_py(), inner=True)
        q = matrix(asked.column("vector").combine_chunks(), dim)
        wide, most = max(ef, k + 1), min(k + 1, len(x))
        owner, nodes, same, scores = [], [], [], []
        for lo in range(0, len(q), 256):
            own = q[lo : lo + 256]
            ids, _ = graph.search(unit(own).astype(np.float32), wide)
            few = np.flatnonzero((ids >= 0).sum(axis=1) < most)
            if len(few):
                ids[few] = -1
                ids[few, :most] = np.argpartition(-(unit(own[few]) @ graph.x.astype(np.float64).T), most - 1, axis=1)[:, :most]
            exact = np.where(ids >= 0, (x[np.maximum(ids, 0)] * own[:, None, :]).sum(axis=2), -np.inf)
            order = np.argsort(-exact, axis=1, kind="stable")[:, :most]
            ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
            r, c = np.nonzero(ids >= 0)
            owner.append(r + lo)
            nodes.append(ids[r, c])
            same.append((x[ids[r, c]] == own[r]).all(axis=1))
            scores.append(exact[r, c])
        owner, at = pa.array(np.concatenate(owner)), pa.array(np.concatenate(nodes))
        flat = [graphs.column(c).combine_chunks().flatten().take(at) for c in ("node", "least")]
        return pa.table([*(asked.column(c).take(owner) for c in ("id", "_q", "times")), *flat, pa.array(np.concatenate(same)), pa.array(np.concatenate(scores))], names=out.names)

    return left.cogroup(right).applyInArrow(answer, out)


def _ring(vector: Column, most: Column) -> Column:
    """A vector's ring by the logarithm of its length, in which no square overflows or vanishes; length 1 lies inside a ring. most: its largest component."""
    squares = F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + (x / most) * (x / most))
    return F.floor((F.log2(most) + F.log2(squares) / 2) * RINGS + F.lit(0.5)).cast("int")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over the length of the longest, in single precision."""
    most = np.abs(x).max(axis=1)
    length = np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(axis=1)) / 2
    return (unit(x) * np.exp2(length - length.max())[:, None]).astype(np.float32)
