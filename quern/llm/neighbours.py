"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its `prefix` nearest reference points (pivots), nearest first, as seen from the pivots' mean.
Vectors that are close see much the same pivots, so inverted lists by pivot bring
them together; pairs that share at least `shared` pivots are verified by
their cosine in double precision. The prefix is as long as links need it: vectors of a sample get partners at the
least cosine of a link, and it is the shortest of PREFIXES with which WANTED of them share enough pivots with theirs. A pair that meets in several lists counts in that of the least shared pivot.

Inside a large group of near copies many pivots are members, nearly equally far from all others, so prefixes say little
there. A pivot with CROWD pivots within a cosine of it (CORE, or more where all vectors lie close together) is a centre instead, and those it covers are pivots no more.
Vectors within that of their nearest centre live there; each is compared with all others that live there and with every
vector that the triangle inequality and the bisecting plane do not rule out as its link, so these links are exact.

Equal vectors are one class. Lists are cut into chunks, and pairs of chunks are
compared as matrices: what comes out is, for each class, the number of vectors linked and one
link of a spanning tree, never the pairs. Pivots are a bounded sample, sqrt(n) * 2 of them while their matrix stays below `pivot_bytes`
(256 MB: 2^19 pivots of 64 numbers, 43,000 of 768; lists of larger tables grow faster than sqrt(n)); every vector is indexed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.components import components

#: Classes of one list that are compared as one matrix.
CHUNK = 1024
#: Lengths of prefix to choose from, the share of a sample's partners that must be found, and the sample's size.
PREFIXES, WANTED, PROBES = (8, 12, 16, 24, 32, 48, 64), 0.99, 512
#: Cosine to a centre from which a vector lives there; pivots within it, itself included, that make a pivot a centre; chunks of a centre's list that meet as one group.
CORE, CROWD, TILES = 0.8, 8, 8
_LONG, _INT = T.LongType(), T.IntegerType()


def sound(vector: Column) -> Column:
    """Whether a vector can be compared: not null, all its components finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plain(vector: Column) -> Column:
    """A vector in double precision, without negative zeros, so that equal vectors have equal hashes."""
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def classes(vectors: DataFrame, key: str, vector: str, scratch: Scratch, mask: int = -1) -> tuple[DataFrame, DataFrame]:
    """(rows: id, node, dim; classes: node, vector, dim, copies), written. node names equal vectors; it is null where a vector is unsound.

    Classes are told apart by 128 bits. A node is the first half of them, but for the few classes whose first halves clash, which are
    named by a hash of both. `mask` cuts the first half, so that tests can make names clash.
    """
    ok = sound(F.col(vector))
    rows = vectors.select(F.col(key).alias("id"), F.when(ok, plain(F.col(vector))).alias("vector"))
    names = [F.when(F.col("vector").isNotNull(), h).alias(n) for n, h in (("node", F.xxhash64("vector").bitwiseAND(F.lit(mask).cast("long"))), ("_name", F.xxhash64("vector", F.lit(1))))]
    rows = rows.select("id", "vector", F.size("vector").alias("dim"), *names)
    kinds = scratch.keep(rows.where("node IS NOT NULL").groupBy("node", "_name").agg(F.any_value("vector").alias("vector"), F.any_value("dim").alias("dim"), F.count(F.lit(1)).alias("copies")))
    rows = rows.select("id", "node", "_name", "dim")
    clash = kinds.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_low")).where("_n > 1")
    if not clash.isEmpty():  # of n vectors about n * n / 2^65 clash: a handful at ten billion
        other = kinds.select("node", "_name").join(clash, "node").where("_name <> _low").select("node", "_name", F.xxhash64("node", "_name").alias("_other"))
        other = F.broadcast(scratch.keep(other))
        rows, kinds = (t.join(other, ["node", "_name"], "left").withColumn("node", F.coalesce("_other", "node")).drop("_other") for t in (rows, kinds))
        kinds = scratch.keep(kinds)
    return scratch.keep(rows.drop("_name")), kinds.drop("_name")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's component; `linked` is symmetric."""
    label = np.arange(len(linked))
    while True:
        seen = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, seen)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions as seen from the mean; what lies on it has none."""
    x = x - mean
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12)


def nearest(near: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` columns with the largest values of each row, largest first."""
    first = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
    return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1).astype(np.int32)


def prefix_for(probes: np.ndarray, pivots: np.ndarray, mean: np.ndarray, least: float, shared: int) -> int:
    """The shortest of PREFIXES with which WANTED of the probes share `shared` pivots with a partner at cosine `least`, towards another probe; the longest if none is enough."""
    towards = np.roll(probes, 1, axis=0)
    aside = towards - (towards * probes).sum(axis=1, keepdims=True) * probes
    some = np.sqrt((aside * aside).sum(axis=1)) > 1e-6
    if not some.any():
        return min(PREFIXES[0], len(pivots))
    probes, aside = probes[some], unit(aside[some])
    partners = least * probes + np.sqrt(max(1 - least * least, 0)) * aside
    most = min(PREFIXES[-1], len(pivots))
    seen = centred(pivots, mean).T
    a, b = (np.concatenate([nearest(centred(x[lo : lo + 64], mean) @ seen, most) for lo in range(0, len(x), 64)]) for x in (probes, partners))
    for prefix in PREFIXES:
        if prefix >= most:
            return most
        same = (a[:, :prefix, None] == b[:, None, :prefix]).any(axis=2).sum(axis=1)
        if (same >= shared).mean() >= WANTED:
            return prefix
    return most


def crowded(pivots: np.ndarray, core: float = CORE) -> tuple[np.ndarray, np.ndarray]:
    """(centres, other pivots with the centres): centres cover at least CROWD pivots that no earlier one does, the fullest go first."""
    full = np.concatenate([(pivots[lo : lo + 512] @ pivots.T >= core).sum(axis=1) for lo in range(0, len(pivots), 512)])
    free, centres = np.ones(len(pivots), bool), []
    for p in np.argsort(-full, kind="stable")[: int((full >= CROWD).sum())]:
        own = free & (pivots @ pivots[p] >= core) if free[p] else free[:0]
        if own.sum() >= CROWD:
            centres.append(p)
            free &= ~own
    free[centres] = True
    return pivots[centres], pivots[free]


def _crowd(x: np.ndarray, copies: np.ndarray, second: np.ndarray, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least member of the component) of each row: every pair of a group, or every pair across its two halves, a tile at a time."""
    links, label = np.zeros(len(x)), np.arange(len(x))
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if cross else (np.arange(len(x)),) * 2
    for i in range(0, len(a), CHUNK):
        for j in range(0 if cross else i, len(b), CHUNK):
            u, v = a[i : i + CHUNK], b[j : j + CHUNK]
            hit = x[u] @ x[v].T >= least
            if not cross and i == j:
                hit |= hit.T
                np.fill_diagonal(hit, False)
            else:
                links[v] += copies[u].astype(np.float64) @ hit
            links[u] += hit @ copies[v].astype(np.float64)
            while (apart := hit & (label[u][:, None] != label[v])).any():
                p = np.flatnonzero(apart.any(axis=1))
                one, two = label[u[p]], label[v[apart[p].argmax(axis=1)]]
                np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
                while (label != label[label]).any():
                    label = label[label]
    return links, label


def link_vectors(
    vectors: DataFrame, least: float = 0.9, prefix: int | None = None, shared: int = 2, pivot_bytes: int = 1 << 28, key: str = "vec_id", vector: str = "embedding", mask: int = -1
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`.

    Cases: vectors that are null, zero or hold null or non-finite components link with nothing and are their own component;
    vectors of different lengths do not link, those of each length are compared among themselves; equal vectors are links; repeated rows are vectors each; a null
    key is never the least of a component and is never kept; an empty table gives no rows; further columns are ignored.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows, kinds = classes(vectors, key, vector, scratch, mask)
        # an index for each length, which are few; what comes out of all of them is handled together
        found = [scratch.keep(_compare(kinds.where(F.col("dim") == r["dim"]), least, prefix, shared, pivot_bytes, r["dim"], scratch)) for r in kinds.select("dim").distinct().orderBy("dim").collect()]
        links = functools.reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "node long, links long, root long")
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
        counts = kinds.select("node", "copies").join(links.groupBy("node").agg(F.sum("links").alias("_l")), "node", "left").join(roots, "node", "left")
        counts = scratch.keep(counts.select("node", (F.coalesce("_l", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("_root")))
        # least keys by class, then by component; classes, not rows, meet on their root
        keyed = scratch.keep(counts.join(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("_id")), "node"))
        firsts = keyed.groupBy("_root").agg(F.min("_id").alias("component_id"))
        named = scratch.keep(keyed.join(firsts, "_root").select("node", "n_links", "component_id"))
        own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
        out = rows.join(named, "node", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"))
        return lasting(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _compare(kinds: DataFrame, least: float, prefix: int | None, shared: int, pivot_bytes: int, dim: int, scratch: Scratch) -> DataFrame:
    """node, links (vectors linked, of other classes), root (a linked node or itself): several rows for a node."""
    n = kinds.count()
    wanted = int(np.clip(2 * n**0.5, PREFIXES[0], max(PREFIXES[-1], pivot_bytes // (8 * dim))))
    drawn = unit(matrix(kinds.orderBy(F.xxhash64("node"), "node").limit(wanted + PROBES).select("vector").toArrow().column(0).combine_chunks(), dim))
    pivots, probes = drawn[:wanted], drawn[wanted:] if len(drawn) >= wanted + 2 else drawn
    mean = pivots.mean(axis=0)
    core = max(CORE, 1 - 0.3 * (1 - float(mean @ mean)))  # mean @ mean: the mean cosine of two vectors
    centres, pivots = crowded(pivots, core)
    seen = centred(pivots, mean).T
    m, prefix = len(pivots), min(prefix or prefix_for(probes, pivots, mean, least, shared), len(pivots))  # lists from m on are those of the centres
    step = int(np.clip((1 << 22) // m, 16, CHUNK))
    shared = min(shared, prefix)
    angles = np.arccos(np.clip([core, least], -1, 1)).sum()
    reach = np.cos(min(angles, np.pi)) - 1e-9
    slack = np.sqrt(max(2 - 2 * least, 0)) * np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) + 1e-6
    described = T.StructType([T.StructField("node", _LONG), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("copies", _LONG), T.StructField("pivots", T.ArrayType(_INT)), T.StructField("visits", T.ArrayType(_INT))])

    def ragged(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)), pa.array(values.astype(np.int32)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                x = unit(matrix(some.column(1), dim))
                order = nearest(centred(x, mean) @ seen, prefix)
                own, visits = np.ones(order.shape, bool), np.zeros((len(order), len(centres)), bool)
                if len(centres):
                    close = x @ centres.T
                    home, top = close.argmax(axis=1), close.max(axis=1)
                    lives = top >= core
                    visits = (close >= reach) & (top[:, None] - close <= slack[home])
                    visits &= ~lives[:, None] | (np.arange(len(centres)) < home[:, None])  # a pair of two homes meets in the lesser one
                    own[lives, 1:] = False
                    order[lives, 0] = m + home[lives]
                row, to = np.nonzero(visits)
                lists = (ragged(np.nonzero(own)[0], order[own], len(order)), ragged(row, m + to, len(order)))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), *lists], described.names)

    index = scratch.keep(kinds.select("node", "vector", "copies").mapInArrow(describe, described))
    room = np.where(np.arange(m + len(centres)) < m, CHUNK, CHUNK * TILES)

    def chunked(column: str) -> np.ndarray:
        lengths = {r["p"]: r["n"] for r in index.select(F.explode(column).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot or centre
        return -(-np.array([lengths.get(p, 0) for p in range(len(room))]) // room)

    chunks, guests = chunked("pivots"), chunked("visits")  # of guests, who meet those that live there but not each other
    posted = T.StructType([T.StructField("list", _INT), T.StructField("i", _INT), T.StructField("j", _INT), T.StructField("second", T.BooleanType()), *described.fields[:4]])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                some = batch.slice(lo, CHUNK)
                node = np.asarray(some.column(0))
                row, where = (np.concatenate([np.asarray(f(some.column(c))) for c in (3, 4)]) for f in (pc.list_parent_indices, pc.list_flatten))
                guest = np.arange(len(row)) >= len(some.column(3).flatten())
                salt = (node[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
                chunk = np.where(guest, chunks[where] + salt % np.maximum(guests[where], 1), salt % np.maximum(chunks[where], 1))
                copies = chunks[where] + np.where(guest, 0, guests[where])
                row, where, chunk = (np.repeat(x, copies) for x in (row, where, chunk))
                other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                keys = (where.astype(np.int32), np.minimum(chunk, other).astype(np.int32), np.maximum(chunk, other).astype(np.int32), chunk > other)
                for k in range(0, len(row), 1 << 15):
                    part = slice(k, k + (1 << 15))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in keys), *(c.take(pa.array(row[part])) for c in some.columns[:4])], posted.names)

    out = T.StructType([T.StructField("node", _LONG), T.StructField("links", _LONG), T.StructField("root", _LONG)])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        here = table.column("list")[0].as_py()
        x = unit(matrix(table.column("vector").combine_chunks(), dim))
        node, copies, second = (table.column(c).to_numpy() for c in ("node", "copies", "second"))
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        if here >= m:
            links, label = _crowd(x, copies, second, cross, least)
            some = np.flatnonzero(links > 0)
            return pa.table([pa.array(node[some]), pa.array(np.rint(links[some]).astype(np.int64)), pa.array(node[label[some]])], names=out.names)
        near = np.asarray(table.column("pivots").combine_chunks().flatten()).reshape(-1, prefix)
        linked = np.zeros((len(x), len(x)), bool)
        a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if cross else (np.arange(len(x)),) * 2
        if len(a) and len(b):
            p, q = (k[e] for k, e in zip((a, b), np.nonzero(x[a] @ x[b].T >= least), strict=True))
            for lo in range(0, len(p), 1 << 15):
                u, v = p[lo : lo + (1 << 15)], q[lo : lo + (1 << 15)]
                same = (near[u][:, :, None] == near[v][:, None, :]).any(axis=2)
                own = (same.sum(axis=1) >= shared) & (np.where(same, near[u], m).min(axis=1) == here)
                linked[u[own], v[own]] = True
            linked |= linked.T
            np.fill_diagonal(linked, False)
        links = linked @ copies.astype(np.float64)
        some = np.flatnonzero(links > 0)
        roots = _roots(linked[np.ix_(some, some)])
        return pa.table([pa.array(node[some]), pa.array(np.rint(links[some]).astype(np.int64)), pa.array(node[some][roots])], names=out.names)

    return index.mapInArrow(post, posted).groupBy("list", "i", "j").applyInArrow(compare, out)
