import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

from quern.llm import substring
from quern.llm.queries import ORACLES, QUERIES
from quern.llm.words import Words

ROOT = "/root/testdata/sf0.01"


def brute(texts, window):
    seen = collections.Counter()
    words = [(t or "").encode().split() for t in texts]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def made(seed, letters, n=60):
    rng = random.Random(seed)
    base = [[rng.choice(letters) for _ in range(rng.randrange(3, 80))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            w += b[a : a + rng.randrange(1, 60)] + [rng.choice(letters) for _ in range(rng.randrange(5))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out + out[:3] + [None, "", " \n", "x " * 700, "ab cd " * 300, "y " * 40]


@pytest.mark.parametrize("seed, letters, window, gram, hot", [(1, "ab", 6, 2, 10**6), (2, "abcdefghij", 6, 3, 4), (3, [f"w{i}" for i in range(400)], 12, 4, 10**6), (4, [f"é{i}" for i in range(50)], 5, 5, 2), (5, "abc", 7, 1, 50)])
def test_equals_brute_force(spark, seed, letters, window, gram, hot):
    texts = made(seed, letters)
    docs = spark.createDataFrame([(i, t, i, -i) for i, t in enumerate(texts)], "doc_id long, text string, spans int, first int")
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(docs, window, gram, hot).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts, window)


def test_rows_without_keys_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (None, text), (1, "z " + text), (1, "only here"), (1, "only here"), (2, None)], "doc_id long, text string")
    out = substring.dedup_substrings(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 40, 40), (0, 40, 40), (1, 2, 0), (1, 2, 0), (1, 41, 40), (2, 0, 0)]
    assert substring.dedup_substrings(docs.limit(0)).count() == 0
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text if r.text is None else r.text.strip()) for r in cut.collect()) == [(0, ""), (0, ""), (1, "only here"), (1, "only here"), (1, "z"), (2, None)]


def test_automaton_counts_and_matches():
    for seed in range(20):
        rng = random.Random(seed)
        pieces = [([rng.choice("ab" if seed % 2 else "abcd") for _ in range(rng.randrange(4, 30))], rng.choice([1, 1, 2])) for _ in range(6)]
        seen = collections.Counter()
        for words, times in pieces:
            for i in range(len(words) - 3):
                seen[tuple(words[i : i + 4])] += times
        for (words, _), runs in zip(pieces, substring.repeated_windows(pieces, 4), strict=True):
            got = {x for a, n in runs for x in range(a, a + n)}
            assert got == {i for i in range(len(words) - 3) if seen[tuple(words[i : i + 4])] > 1}


def test_matching_statistics_of_foreign_text():
    for seed in range(20):
        rng = random.Random(seed)
        pieces = [[rng.choice("abc") for _ in range(rng.randrange(4, 30))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for words in pieces:
            automaton.add(words)
        automaton.close()
        text = [rng.choice("abcd") for _ in range(60)]
        often = collections.Counter(tuple(p[i:j]) for p in pieces for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        want = [next(n for n in range(i + 1, -1, -1) if n == 0 or often[tuple(text[i + 1 - n : i + 1])] > 1) for i in range(len(text))]
        assert automaton.matches(text) == want


@pytest.mark.parametrize("hot", [10**6, 3])
def test_nothing_goes_but_by_an_automaton(spark, hot):
    docs = spark.createDataFrame(list(enumerate(made(3, [f"w{i}" for i in range(400)]))), "doc_id long, text string")
    rows = substring.named(docs, "doc_id", "text")
    assert substring.repeated_spans(rows, 12, 4, hot).count() > 0
    assert substring.repeated_spans(rows, 12, 4, hot, find=lambda pieces, window: [[] for _ in pieces]).count() == 0


def test_every_window_is_in_one_piece():
    texts = [t.encode() for t in made(9, "abcdef") if t]
    owner, first, n, mini, content, _ = substring.find_pieces(Words(texts), 6, 3)
    covered = collections.Counter((o, f + k) for o, f, m in zip(owner.tolist(), first.tolist(), n.tolist(), strict=True) for k in range(m))
    assert covered == collections.Counter((o, i) for o, t in enumerate(texts) for i in range(len(t.split()) - 5))
    at = collections.defaultdict(set)
    for o, f, m, key in zip(owner.tolist(), first.tolist(), n.tolist(), mini.tolist(), strict=True):
        for k in range(m):
            at[tuple(texts[o].split()[f + k : f + k + 6])].add(key)
    assert all(len(keys) == 1 for keys in at.values()) and np.unique(content).size > 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    want = sorted(con.sql(ORACLES["op1_suffix_automaton_dedup"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op1_suffix_automaton_dedup"](spark, ROOT).collect()) == want
    assert sum(w[2] for w in want) > 0
