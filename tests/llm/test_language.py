import collections
import math
import zlib

import numpy as np
import pytest

from quern.llm import language as L
from quern.llm.common import Scratch

ROOT = "/root/testdata/sf0.01"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    count, ends = collections.Counter(), 0
    for key, text in rows:
        if zlib.crc32(str(key).encode()) % 7 != 2 or key is None:
            count.update(lower(text).encode().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for key, text in rows:
        c = [count[w] for w in lower(text).encode().split()] + [ends]
        out.append((key, key is not None and zlib.crc32(str(key).encode()) % 7 == 2, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


@pytest.mark.parametrize("table", [0, 1000, L.TABLE])
def test_counts_and_base_scores(spark, table):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(300)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (None, "of x"), (16, ""), (16, ""), (17, "The the Of\tx " * 3000)]
    out = L.score_language(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3), table=table).collect()
    want = brute(rows)
    got = sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    for r, w in zip(got, sorted(want, key=lambda w: (w[0] is None, w[0] or 0, w[2])), strict=True):
        assert tuple(r)[:5] == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
        assert r.score < 0


def test_beats_the_base_on_held_out_text(spark):
    out = L.score_language(spark.read.parquet(f"{ROOT}/documents.parquet")).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and held
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.25


def fitted(spark, texts, scratch, block=1 << 23):
    rows = spark.createDataFrame([(i, False, i * 7919, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, order long, text string").repartition(3)
    known = L.vocabulary(scratch.keep(L.count_words(rows)), len(texts))
    return known, L.Layout(known), L.fit_language(L.encoded(rows, known), known, scratch, block)


def test_probabilities_equal_brute_force_and_sum_to_one(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 200) % 900) for _ in range(60)]
    with Scratch(spark) as scratch:
        known, layout, model = fitted(spark, texts, scratch, 2000)
    assert max(np.abs(v).max() for v in model.vectors) > 0.3 and known.n == 60 * 201
    one, two, out, word = (v.astype(float) for v in model.vectors)
    says = len(known.hashes)  # every word of this corpus has an output vector
    kind = L.kinds(known.hashes)
    for a, b in ((3, 5), (L.START, L.START), (says - 1, 0), (L.SEEN + 7, 2)):
        h = one[a] + two[b]
        classes = np.exp(out @ h + model.bias)
        classes /= classes.sum()
        chance = [classes[w] if w < L.HEAD else 0.0 for w in range(says)]
        unseen = 0.0
        for k in range(L.TAIL):
            mine = [w for w in range(L.HEAD, says) if kind[w] == k]
            mass = {w: (known.counts[w] + 1) * math.exp(word[w] @ h) for w in mine}
            total = sum(mass.values()) + known.rest[k]
            unseen += classes[L.HEAD + k] * known.rest[k] / total
            for w in mine:
                chance[w] = classes[L.HEAD + k] * mass[w] / total
        assert sum(chance) + unseen + classes[-1] == pytest.approx(1, rel=1e-9)
        said = [0, 1, L.HEAD - 1, L.HEAD, says // 2, says - 1, L.START]
        got = [model.log_chances(np.array([b, a, w], np.int32), np.array([2]), layout, known.rest)[0] + (math.log(known.counts[w] + 1) if L.HEAD <= w < says else 0) for w in said]
        assert got == pytest.approx([math.log(chance[w] if w < says else classes[-1]) for w in said], abs=1e-4)


def test_a_repeated_text_is_learned(spark):
    with Scratch(spark) as scratch:
        known, layout, model = fitted(spark, ["a b c " * 400] * 40, scratch)
    rank = {w: int(known.ranks(L.Words([w.encode()]).hash)[0]) for w in "abc"}
    tokens = np.array([rank["a"], rank["b"], rank["c"]], np.int32)
    assert math.exp(model.log_chances(tokens, np.array([2]), layout, known.rest)[0]) > 0.8


def test_layout_changes_nothing(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(200)
    docs = docs.unionByName(docs.limit(3)).cache()
    few, many = ({(r.doc_id, r.n_tokens): r.score for r in L.score_language(d, block=10_000).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(11)))
    worst = max(abs(few[k] / many[k] - 1) for k in few)
    assert few.keys() == many.keys() and worst < 1e-6  # what single precision leaves


def test_pieces_of_a_long_text_hold_each_token_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 5)
    ids = np.arange(17, dtype=np.int32)
    rows = L._spread(spark.createDataFrame([(5, bytearray(ids.tobytes()))], "order long, ids binary"), 4).collect()
    held = [np.frombuffer(r.ids, np.int32).tolist() for r in rows]
    whole = [L.START, L.START, *range(17)]
    assert sorted(held) == sorted(whole[i : i + L.PIECE + 2] for i in range(0, 17, L.PIECE)) or held == [whole]


def test_empty_table(spark):
    assert L.score_language(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_table_is_filled_from_words_of_equal_counts(spark):
    often = [f"often{i}" for i in range(40)] * 5
    once = [f"once{i}" for i in range(1800)]
    rows = spark.createDataFrame([(" ".join(often + once),)], "text string")
    with Scratch(spark) as scratch:
        counts = scratch.keep(L.count_words(rows))
        whole = L.vocabulary(counts, 1)
        assert len(whole.hashes) == 1840
        for table in (0, 1, 39, 40, 41, 100, 1839, 1840):
            known = L.vocabulary(counts, 1, table)
            assert len(known.hashes) == table and len(set(known.hashes.tolist())) == table
            assert known.counts.tolist() == ([5] * 40 + [1] * 1800)[:table]
            assert (known.n, known.v) == (whole.n, whole.v) and known.noise.sum() == pytest.approx(whole.n)
            if table >= 40:
                assert known.hashes.tolist() == [*whole.hashes[:40].tolist(), *sorted(whole.hashes[40:].tolist())[: table - 40]]


def test_row_sums_are_those_of_each_number():
    rng = np.random.default_rng(3)
    for size, most in ((1, 1), (7, 3), (4096, 60), (5000, 3000), (300, 1)):
        at, rows = rng.zipf(1.3, size) % most, rng.normal(size=(size, 4))
        numbers, times, total = L._row_sums(rows, at)
        assert sorted(numbers.tolist()) == sorted(set(at.tolist())) and (np.diff(times) <= 0).all()
        for number, n, found in zip(numbers, times, total, strict=True):
            assert n == (at == number).sum() and np.allclose(found, rows[at == number].sum(axis=0))


def test_large_energies_are_normalised_as_small_ones(spark):
    texts = [" ".join(f"w{int(x)}" for x in np.random.default_rng(i).zipf(1.3, 200) % 900) for i in range(20)]
    with Scratch(spark) as scratch:
        known, layout, model = fitted(spark, texts, scratch)
    tokens, places = np.array([4, 70, 90, 3, 500, 2, L.START], np.int32), np.arange(2, 7)
    for scale in (1.0, 10.0, 40.0):
        grown = L.Bilinear([v * np.float32(scale) for v in model.vectors[:2]] + model.vectors[2:], model.bias, model.grown)
        one, two, out, word = (v.astype(float) for v in grown.vectors)
        want = []
        for p in places:
            h, t = one[tokens[p - 1]] + two[tokens[p - 2]], tokens[p]
            c, energy = layout.classes[t], out @ h + grown.bias
            chance = energy[c] - np.logaddexp.reduce(energy)
            if L.HEAD <= c < L._END:
                words = layout.words[layout.first[c - L.HEAD] : layout.first[c - L.HEAD + 1]]
                within = np.append(word[words] @ h + np.log(layout.counts[words]), np.log(known.rest[c - L.HEAD]))
                chance += word[t] @ h - np.logaddexp.reduce(within)
            want.append(chance)
        got = grown.log_chances(tokens, places, layout, known.rest)
        assert got == pytest.approx(want, rel=1e-5, abs=1e-3)


def test_a_context_that_recurs_is_normalised_once(spark, monkeypatch):
    texts = [" ".join(f"w{int(x)}" for x in np.random.default_rng(i).zipf(1.3, 200) % 900) for i in range(5)]
    with Scratch(spark) as scratch:
        known, layout, model = fitted(spark, texts, scratch)
    part = [4, 70, 90, 3, 500, 2, L.START]
    rows, lowered = [], L._lowered
    monkeypatch.setattr(L, "_lowered", lambda energy, least: rows.append(energy.shape) or lowered(energy, least))
    one = model.log_chances(np.array(part, np.int32), np.arange(2, 7), layout, known.rest)
    rows.clear()
    many = model.log_chances(np.array(part * 50, np.int32), (np.arange(50)[:, None] * 7 + np.arange(2, 7)).ravel(), layout, known.rest)
    assert many == pytest.approx(np.tile(one, 50), abs=1e-5)
    assert sum(n for n, width in rows if width == L.CLASSES) == 5


def test_contexts_of_frequent_words_are_normalised_in_one_table(spark, monkeypatch):
    texts = [" ".join(f"w{int(x)}" for x in np.random.default_rng(i).zipf(1.3, 200) % 900) for i in range(5)]
    with Scratch(spark) as scratch:
        known, layout, model = fitted(spark, texts, scratch)
    rng = np.random.default_rng(7)
    tokens = np.append(rng.integers(0, 300, 400), [L.START, L.START, 5, L.SEEN + 3, 9, 4, L.START]).astype(np.int32)
    places, lowered = np.arange(2, len(tokens)), L._lowered
    monkeypatch.setattr(L, "OFTEN", 250)
    for scale in (1.0, 30.0):  # the larger energies are not held by products in single precision
        vectors = [v * np.float32(scale) for v in model.vectors[:2]] + model.vectors[2:]
        found = []
        for paid in (10**9, 1):
            rows = []
            monkeypatch.setattr(L, "PAID", paid)
            monkeypatch.setattr(L, "_lowered", lambda energy, least, rows=rows: rows.append(energy.shape) or lowered(energy, least))
            found.append(L.Bilinear(vectors, model.bias, model.grown).log_chances(tokens, places, layout, known.rest))
            if scale == 1:
                often = sum(tokens[p - 1] < 250 and (L.START if tokens[p - 1] == L.START else tokens[p - 2]) < 250 for p in places)
                assert often > 200 and sum(n for n, width in rows if width == L.CLASSES) <= len(places) - often * (paid == 1)
        assert found[1] == pytest.approx(found[0], rel=1e-5, abs=1e-4)
