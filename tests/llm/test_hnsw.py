import collections

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import hnsw
from quern.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def brute(ids, x, asked, k):
    out = {}
    for a in asked:
        i = ids.index(a)
        scores = (x * x[i]).sum(axis=1)
        out[a] = sorted(((-s, j) for s, j in zip(scores.tolist(), ids, strict=True) if j != a))[:k]
    return out


def check(rows, want, recall):
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    assert set(got) == set(want)
    hits = total = 0
    for a, best in want.items():
        own = sorted(got[a])
        assert [r for r, *_ in own] == list(range(1, len(best) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        hits += sum(s <= best[-1][0] + 1e-12 for _, s, _ in own)
        total += len(best)
    assert hits >= recall * total


def test_query_recall(spark):
    t = pq.read_table(f"{ROOT}/embeddings.parquet").to_pydict()
    want = brute(t["vec_id"], np.array(t["embedding"], float), [i for i in t["vec_id"] if i % 20 == 0], 20)
    check(QUERIES["op10_small_world_search"](spark, ROOT).collect(), want, 0.97)


def test_shards_clusters_copies_and_lengths(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.05) * rng.uniform(0.5, 2, 3000)[:, None]
    x[1000:2000] = x[999]  # a third of all rows are one vector
    ids = list(range(3000))
    docs = spark.createDataFrame([(i, [float(e) for e in v], 0, 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int, node int")
    asked = [*range(0, 3000, 50)]
    out = hnsw.search_vectors(docs, docs.where("vec_id % 50 = 0"), shard_rows=700, block_rows=20).collect()
    want = brute(ids, x, asked, 20)
    check(out, want, 0.95)
    assert [r.vec_id for r in sorted(out) if r.query_id == 1500] == [j for _, j in want[1500]]


@pytest.mark.parametrize("case", ["lognormal 0.5", "lognormal 1", "outlier", "tiny", "huge", "spread"])
def test_recall_whatever_the_lengths(spark, case):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2048, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "outlier":
        x[17] *= 10_000
    x *= {"lognormal 0.5": np.exp(0.5 * rng.normal(size=(2048, 1))), "lognormal 1": np.exp(rng.normal(size=(2048, 1))), "tiny": 1e-25, "huge": 1e20, "spread": 10.0 ** rng.uniform(-150, 140, (2048, 1))}.get(case, 1.0)
    ids = list(range(2048))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = hnsw.search_vectors(docs, docs.where("vec_id % 20 = 0")).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r.query_id].add(r.vec_id)
    want = {a: {j for _, j in best} for a, best in brute(ids, x, ids[::20], 20).items()}
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[a] & want[a]) for a in want) >= 0.97 * 20 * len(want)


def test_a_query_lost_in_its_shard_is_compared_with_all_of_it(spark):
    x = np.random.default_rng(8).normal(size=(300, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graph = hnsw.build(x.astype(np.float32))
    assert (np.sort(graph.search(x[:5].astype(np.float32), 300)[0], axis=1) == np.arange(300)).all()
    out = hnsw.search_vectors(docs, docs.where("vec_id % 20 = 0"), k=299).collect()
    assert len(out) == 15 * 299 and len({(r.query_id, r.vec_id) for r in out}) == len(out)


def sound(v):
    return v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)


def row_by_row(rows, asked, k):
    """What the query rows (indices) should get, as sorted (query, rank, key, score)."""
    out = []
    for i in asked:
        q, v = rows[i]
        if sound(v):
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), key is None, key or 0) for j, (key, w) in enumerate(rows) if j != i and sound(w) and len(w) == len(v)]
            out += [(q, n + 1, None if none else key, -score) for n, (score, none, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, mask", [(3, -1), (20, -1), (2, 1)])
def test_odd_rows(spark, k, mask):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 2.0]), (8, [1.0, None]), (9, [1.0, 0.0])]
    rows += [(0, [3.0, 1.0]), (0, [3.0, 1.0]), (0, [2.0, 5.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0]), (12, [0.5, 0.5, 0.5]), (None, [1.0, 2.0]), (13, [-0.0, 1.0])]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, rank int, node string").repartition(3)
    out = hnsw.search_vectors(docs, docs, k=k, mask=mask).collect()
    assert sorted(map(tuple, out), key=str) == row_by_row(rows, range(len(rows)), k)
    some = hnsw.search_vectors(docs, docs.where("vec_id % 2 = 0"), k=k, mask=mask).collect()
    assert sorted(map(tuple, some), key=str) == row_by_row(rows, [i for i, r in enumerate(rows) if r[0] is not None and r[0] % 2 == 0], k)
    assert hnsw.search_vectors(docs.limit(0), docs.limit(0)).count() == 0 == hnsw.search_vectors(docs, docs.limit(0)).count()


def test_graphs_are_flat_and_connected():
    x = np.random.default_rng(0).normal(size=(900, 8)).astype(np.float32)
    graph = hnsw.build(x)
    assert all(a.dtype == np.int32 and len(a) == 900 for a in graph.layers)
    reached, front = {graph.entry}, [graph.entry]
    while front:
        front = [j for i in front for j in graph.layers[0][i].tolist() if j >= 0 and not (j in reached or reached.add(j))]
    assert len(reached) > 890
