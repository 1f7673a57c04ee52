import collections
import random
import re
import zlib

import pytest

from quern.llm.spelling import count_words, near_words, spelling_groups

SCHEMA = "doc_id long, text string, word string, n long"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, garble, least):
    """Every run by itself, spelled out."""
    out = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if garble and h % garble == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least}


def brute(words, times):
    out = {}
    for w, n in words.items():
        near = [o for o in words if one_apart(w, o)]
        best = min(near, key=lambda o: (-words[o], o.encode()), default=None)
        out[w] = (best if best and words[best] >= times * n else None, n, len(near))
    for w, (form, n, k) in list(out.items()):
        root, seen = w, 0
        while out[root][0]:
            root, seen = out[root][0], seen + 1
            assert seen < 100
        out[w] = (form, root, n, k, words[form] if form else None)
    return out


def texts(seed, alphabet, letters, docs):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(alphabet, k=r.choice(letters))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = [r.choice(vocabulary[: r.choice((3, 10, 60))]) for _ in range(40)]
        rows.append((r.choice((i, i, None)), r.choice(" \n-_9, ").join(words), "extra", 5))
    return rows + rows[:3]


@pytest.mark.parametrize("seed, alphabet, letters, garble", [(1, "abC", (5, 6, 7), 7), (2, "aéÿÀz", (4, 5, 6), 3), (3, "ab", (5, 6, 9), None)])
def test_equals_comparing_all_words(spark, seed, alphabet, letters, garble):
    rows = texts(seed, alphabet, letters, 40) + [(1, None, "", 0), (2, "", "", 0), (3, "9 日本 ß×÷µ ªº", "", 0), (4, "zz" * 9000 + " " + "zz" * 8999 + "z", "", 0)] * 3
    out = spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), garble=garble).collect()
    want = brute({w: n for w, n in counted(rows, garble, 5).items() if n >= 3}, 2)
    assert len(out) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want
    assert any(v[0] for v in want.values())


def test_counts_are_whole_however_often_they_are_handed_on(spark):
    rows = texts(4, "abc", (1, 2, 3), 20)
    got = {r.word: r.n for r in count_words(spark.createDataFrame(rows, SCHEMA), 1, 5, most_held=3).collect()}
    assert got == counted(rows, 5, 1)


def test_anagrams_seldom_meet_and_near_ones_always_do(spark):
    r = random.Random(5)
    base = list("abcdefgh")
    words = {"".join(r.sample(base, 8)): 1 for _ in range(300)}
    words |= {w[:k] + x + w[k + 1 :]: 2 for w in list(words)[:50] for k, x in ((0, "z"), (7, "y"), (3, "a"))}
    words |= {w[:4] + "q" + w[4:]: 3 for w in list(words)[:50]}
    got = {(x.word, x.other) for x in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_empty_and_chains(spark):
    assert spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    chain = ["aaaaa", "baaaa", "bbaaa", "bbbaa", "bbbba", "bbbbb"]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)), "", 0)]
    out = {r.word: (r.form, r.root) for r in spelling_groups(spark.createDataFrame(rows, SCHEMA), garble=None).collect()}
    assert out == {w: (chain[i + 1] if i < 5 else None, "bbbbb") for i, w in enumerate(chain)}
    with pytest.raises(ValueError):
        spelling_groups(spark.createDataFrame([], SCHEMA), times=1)
