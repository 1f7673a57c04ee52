import random

import duckdb
import numpy as np
import pytest

from quern.llm import jaccard
from quern.llm.common import Scratch
from quern.llm.components import components
from quern.llm.jaccard import differences, jaccard_components, shingle_sets, signatures, without_near_copies
from quern.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.01"


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(texts, n, num, den):
    sets = []
    for t in texts:
        w = lower(t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [(len(s), r) for s, r in zip(sets, roots(len(sets), links), strict=True)]


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Of", "of"]
    texts = []
    for size in (2, 3, 4, 12, 30, 60, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(max(2, size // 25))):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                copy = copy[: rng.randrange(1, size + 1)]
            texts.append(rng.choice([" ", "\n"]).join(copy))
    line = " ".join(rng.choice(vocabulary) for _ in range(20))
    texts += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["", None, " \n ", "a", "A", "a b", "a  B", "x " * 500, "x " * 900, *texts[:5]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, n, num, den, frequent, least, short", [(1, 3, 90, 100, 1 << 16, 64, 12), (2, 3, 80, 100, 1 << 16, 3, 2), (3, 5, 80, 100, 200, 2, 1), (4, 3, 90, 100, 1 << 16, 2, 3)])
def test_equals_brute_force(spark, seed, n, num, den, frequent, least, short):
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, node int, size int").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, num, den, frequent, least, short).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts, n, num, den)


def test_rows_without_keys_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A B C D"), (None, None), (7, ""), (8, ""), (None, "z z z")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(docs).collect())
    assert out == [(0, 0, 0), (0, 1, 0), (0, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_signatures_meet_for_every_pair_that_is_alike():
    rng = np.random.default_rng(0)
    for n in (5, 40, 130, 700):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        frequent = np.sort(rng.choice(base, n * 3 // 4, replace=False))
        order = rng.permutation(len(frequent))
        for _ in range(30):
            x, y = (np.unique(np.concatenate((np.delete(base, rng.integers(0, n, max(1, n // 25))), rng.integers(1, 2**63, n // 30).astype(np.uint64)))) for _ in range(2))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            sx, px = signatures(x, (x >> np.uint64(7)) % np.uint64(9), frequent, order, 80, 100)
            sy, py = signatures(y, (y >> np.uint64(7)) % np.uint64(9), frequent, order, 80, 100)
            met, asked = np.intersect1d(sx, sy), max(6, min(len(x), len(y)) // 25)
            fit = [k for k in met if (len(x) - px[sx == k].min() + asked - 1) * 180 // 80 - len(x) >= len(y) and (len(y) - py[sy == k].min() + asked - 1) * 180 // 80 - len(y) >= len(x)]
            singles = sum(k % 2 == 0 for k in fit)
            assert len(fit) > singles or singles >= min(asked, both)


def test_differences_meet_for_every_pair_that_is_alike():
    rng = np.random.default_rng(1)
    for n in (20, 150):
        base = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        spare = rng.integers(1, 2**63, n).astype(np.uint64)
        sets = []
        for k in range(60):
            own = base if k < 20 else sets[k - 20]  # copies of copies
            gone = rng.choice(len(own), rng.integers(1, n // 6), replace=False)
            sets.append(np.unique(np.concatenate((np.delete(own, gone), rng.choice(spare, rng.integers(0, n // 8), replace=False)))))
        found, alone = [differences(base, x, 80, 100) for x in sets], 0
        for i, x in enumerate(sets):
            assert found[i][0] == (180 * len(np.intersect1d(x, base)) >= 80 * (len(x) + len(base)))
            for j in range(i):
                y = sets[j]
                if 180 * len(np.intersect1d(x, y)) >= 80 * (len(x) + len(y)) and not (found[i][0] and found[j][0]):
                    alone += 1
                    assert len(np.intersect1d(found[i][2], found[j][2])) >= max(found[i][1], found[j][1])
        assert alone > 3


def boilerplate(spark, n, own):
    """Documents of 10 of 14 lines, each with `own` words of its own."""
    rng = random.Random(n)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(14)]
    texts = ["\n".join([*sorted(rng.sample(lines, 10)), " ".join(f"u{i}x{j}" for j in range(own))]) for i in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("own", [8, 26])  # documents that link, and some that hardly ever do
def test_of_documents_of_shared_lines_few_pairs_are_compared(spark, monkeypatch, own):
    compared = []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return inner(pairs, *rest)

    inner = jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", counted)
    numbers = {}
    for n in (250, 1000):
        compared.clear()
        texts, docs = boilerplate(spark, n, own)
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 5, 80, 100).collect()}
        if n == 250:
            assert [out[i] for i in range(n)] == brute(texts, 5, 80, 100)
        numbers[n] = sum(compared)
    assert numbers[1000] < (0.2 if own == 8 else 0.03) * (1000 * 999 // 2)


def test_names_that_clash_are_told_apart(spark):
    texts = made(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, mask=15).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts, 3, 90, 100)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(600, i) for i in range(700, 760)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame([*links, (5, 5), (None, 1)], "a long, b long"), scratch).collect()}
        assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    want = roots(800, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def test_words_shorter_than_a_shingle_count_as_one():
    sets = shingle_sets([b"", b"a", b"A b", b"a b c", b"a b"], 3)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1] and sets[2] == sets[4] and sets[1] != sets[2]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    want = sorted(con.sql(ORACLES["op9_token_combination_join"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op9_token_combination_join"](spark, ROOT).collect()) == want
    assert sum(w[0] != w[2] for w in want) > 10


def test_one_row_of_each_component_stays(spark):
    texts = made(7)
    docs = spark.createDataFrame([*((i, t, i % 3) for i, t in enumerate(texts)), (None, texts[0], 1), (None, "quite alone here now", 1), (None, "quite alone here now", 1)], "doc_id long, text string, _t1 int")
    kept = without_near_copies(docs, 3, 80, 100)
    assert kept.columns == docs.columns
    want = sorted(i for i, (n, root) in enumerate(brute(texts, 3, 80, 100)) if n == 0 or root == i)
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == want and [r.text for r in rows if r.doc_id is None] == ["quite alone here now"]
    assert all(r.text == texts[r.doc_id] and r._t1 == r.doc_id % 3 for r in rows if r.doc_id is not None)
    assert without_near_copies(docs.limit(0)).count() == 0


def test_repeated_signatures_take_one_shuffle(spark):
    rows = [(1, 9, 5, 9), (2, 9, 5, 9), (2, 9, 5, 9), (3, 8, 6, 8), (4, 7, 7, 7), (4, 7, 7, 7), (1, 9, 8, 3), (4, 7, 8, 2), (3, 8, 8, 1)]
    found = jaccard._repeated(spark.createDataFrame(rows, "node long, size int, sig long, most int"))
    # all rows of a signature that several sets have, each set's once; of 7, which one set posts twice, one may stay; 6 goes
    assert {tuple(r) for r in found.where("sig <> 7").collect()} == {(5, 1, 9, 9), (5, 2, 9, 9), (8, 1, 9, 3), (8, 4, 7, 2), (8, 3, 8, 1)}
    assert found.count() <= 6
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_postings_are_not_written(spark, monkeypatch):
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(40)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(docs).collect()} == set(range(0, 40, 2))
    assert ["node", "size", "sig", "most"] not in kept  # all signatures of all texts, before those that occur once are left out
