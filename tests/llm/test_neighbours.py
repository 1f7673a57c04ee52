import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quern.llm import neighbours
from quern.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.01"


def brute(ids, vectors, least=0.9):
    x = np.array([v if v is not None and len(v) == 8 and all(e is not None and np.isfinite(e) for e in v) and any(v) else [np.nan] * 8 for v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    roots = neighbours._roots(linked)
    out = []
    for i in range(len(ids)):
        own = [ids[j] for j in range(len(ids)) if roots[j] == roots[i] and ids[j] is not None]
        c = min(own) if own else None
        out.append((ids[i], int(linked[i].sum()), c, ids[i] is not None and ids[i] == c))
    return out


def made(n=600, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.25], n)[:, None]
    x[:50] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize("chunk", [1024, 32])
def test_equals_brute_force_up_to_recall(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    vectors = [[float(e) for e in v] for v in made()]
    vectors += [None, [0.0] * 8, [1.0] * 7 + [None], [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0] * 3, [], [2 * e for e in vectors[0]], [1e30 * e for e in vectors[0]], vectors[7]]
    ids = [*range(len(vectors) - 1), None]
    docs = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), "vec_id long, embedding array<float>, node long").repartition(3)
    got = sorted((tuple(r) for r in neighbours.link_vectors(docs).collect()), key=lambda r: (r[0] is None, r[0]))
    want = brute(ids, vectors)
    assert [r[0] for r in got] == [r[0] for r in want]
    links, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.97 * links
    assert sum(g == w for g, w in zip(got, want, strict=True)) > 0.8 * len(want)
    assert [g[1:] for g, w in zip(got[600:], want[600:], strict=True) if w[1] == 0] == [w[1:] for w in want[600:] if w[1] == 0]


def test_near_copies_are_all_found(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 64)) * 0.3, base[:1] + rng.normal(size=(300, 64)) * 0.1])
    docs = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.link_vectors(docs).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.97 * want.sum() and want.sum() > 1000 and all(got[i] <= want[i] for i in got)


@pytest.mark.parametrize("n, noise, chunk", [(6000, 0.2, 1024), (3000, 0.3, 64)])
def test_a_third_near_copies_of_one_vector(spark, monkeypatch, n, noise, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x, k = rng.normal(size=(n, 64)), n // 3
    x[:k] = x[0] + rng.normal(size=(k, 64)) * noise
    docs = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x))}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.link_vectors(docs).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[lo : lo + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for lo in range(0, n, 1000)])
    assert all(got[i][0] <= want[i] for i in got)
    recall = sum(g for g, _ in got.values()) / want.sum()
    assert recall >= 0.99 and want.sum() > 0.1 * k * k, recall
    assert sum(got[i][1] == 0 for i in range(k) if want[i]) >= 0.99 * (want[:k] > 0).sum()


def test_query_equals_sql_and_empty_table(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{ROOT}/embeddings.parquet')")
    want = sorted(con.sql(ORACLES["op5_pivot_permutation_links"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op5_pivot_permutation_links"](spark, ROOT).collect()) == want
    assert neighbours.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("mask", [-1, 3])
def test_vectors_of_every_length_link_among_themselves(spark, mask):
    vectors = [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, -1.0, 0.0], [1.0, 2.0], [1.0, 2.0], [-2.0, 1.0], [5.0], [7.0], [-1.0], [0.0, -0.0, 1.0, 0.0], [-0.0, 0.0, 2.0, 0.0], [1.0, 1.0, 1.0]]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.link_vectors(docs, mask=mask).collect()}
    want = {}
    for i, v in enumerate(vectors):
        linked = [j for j, w in enumerate(vectors) if j != i and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9]
        first = min([i, *linked])  # components of these vectors are cliques but for the last one's
        want[i] = (len(linked), first, first == i)
    assert got == want


def cone(n, mean, pairs, cosine, seed=0, dim=64):
    """Unit vectors of a mean cosine to each other, the last `pairs` at `cosine` to the first ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.sqrt((1 - mean) / dim)
    x[:, 0] = np.sqrt(mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, towards = x[:pairs], x[pairs : 2 * pairs]
    aside = towards - (towards * own).sum(axis=1, keepdims=True) * own
    x[n - pairs :] = cosine * own + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    return x


@pytest.mark.parametrize("mean", [0.6, 0.7, 0.8])
def test_links_are_found_where_all_vectors_lie_close_together(spark, mean):
    n, pairs = 20_000, 4000
    x = cone(n, mean, pairs, 0.92)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (np.concatenate(s) for s in zip(*((r + lo, c) for lo in range(0, n, 2000) for r, c in [np.nonzero(u[lo : lo + 2000] @ u.T >= 0.9)]), strict=True))
    linked = a != b
    a, b = a[linked], b[linked]
    assert len(a) >= 2 * pairs
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    got = neighbours.link_vectors(spark.createDataFrame(table).repartition(8)).toArrow().sort_by("vec_id")
    assert pc.sum(got["n_links"]).as_py() >= 0.95 * len(a)
    label = np.asarray(got["component_id"])
    assert (label[a] == label[b]).mean() >= 0.97  # links whose ends are in one component


def test_prefixes_grow_where_links_need_it():
    for mean, least in ((0.0, 8), (0.8, 24)):
        x = cone(3000, mean, 1, 0.92)
        pivots, probes = x[:283], x[283:795]
        prefix = neighbours.prefix_for(probes, pivots, pivots.mean(axis=0), 0.9, 2)
        assert prefix >= least and prefix in neighbours.PREFIXES
    same = np.repeat(x[:1], 20, axis=0)
    assert neighbours.prefix_for(same, same, same[0], 0.9, 2) == 8
