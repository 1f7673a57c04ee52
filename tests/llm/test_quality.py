import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm.quality import FEATURES, _descend, _Rows, accepted, features, fit, fit_quality, score_quality
from quern.llm.words import Words, windows

ROOT = "/root/testdata/sf0.01"


def test_words_are_cut_as_the_rule_says():
    texts = [b"", b"  a b\x1fc \t\r\n", "é x É".encode(), b"\x00 \x85 a", b"a"]
    words = Words(texts)
    got = [[words.buffer[s:e] for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.first, words.first[1:], strict=False)]
    assert got == [t.split() for t in texts]
    assert len(words.hash) == len(words.start) and words.hash[0] == words.hash[-1] == words.hash[-2]
    assert (Words([b"The END"], True).hash == Words([b"x the end"]).hash[1:]).all()
    assert Words([]).counts().tolist() == [] and Words([b" "]).counts().tolist() == [0]


def test_windows_depend_on_their_words_alone():
    words = Words([b"a b c a b d a b c"])
    three = windows(words.hash, 3, np.uint64(0x9E3779B97F4A7C15))
    assert len(three) == 7 and three[0] == three[6] and len(set(three.tolist())) == 6


def test_features_are_indicators():
    owner, feature = features([b"a a a", b"", b"a"])
    assert sorted(set(owner.tolist())) == [0, 2] and len(set(zip(owner.tolist(), feature.tolist(), strict=True))) == len(owner)


def test_one_class_or_no_rows_give_the_share():
    assert fit([], np.zeros(0)).scores([b"x", b""]).tolist() == [0.5, 0.5]
    assert (fit([b"x"] * 8, np.ones(8)).scores([b"", b"y"]) > 0.8).all()


def test_held_out_rows_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and r.quality == 1]
    bad = [r.score for r in rows if r.held_out and r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    kept = accepted(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == sum(r.predicted for r in rows)
    assert sorted(kept.select(*docs.columns).collect()) == sorted(docs.join(kept.select("doc_id"), "doc_id", "left_semi").collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a " * 100_000, 3), (2, "a " * 100_000, 3), (3, "b", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 0), (99, 1)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 2, 3] and all(0 <= r.score <= 1 for r in out)
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def exact_dual(x, y, cost):
    """The hinge loss' dual by trying every set of rows at 0, at `cost` and between, until one meets all conditions of the optimum."""
    q = (x @ x.T + 1) * np.outer(y, y)
    for at in itertools.product("0cf", repeat=len(y)):
        alpha, free = np.where(np.array(at) == "c", cost, 0.0), np.array(at) == "f"
        if free.any():
            alpha[free] = np.linalg.lstsq(q[np.ix_(free, free)], 1 - q[np.ix_(free, ~free)] @ alpha[~free])[0]
        slope = q @ alpha - 1
        if (alpha > -1e-9).all() and (alpha < cost + 1e-9).all() and all(abs(g) < 1e-9 if f == "f" else g > -1e-9 if f == "0" else g < 1e-9 for f, g in zip(at, slope, strict=True)):
            return alpha
    raise AssertionError("no optimum")


def test_descent_reaches_the_exact_dual():
    rng = np.random.default_rng(3)
    for n, cost in [(2, 1.0), (4, 0.3), (6, 1.0), (7, 0.2), (7, 5.0)] * 3:
        chosen = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(n)]
        ratio, y = np.zeros(FEATURES), np.where(np.arange(n) % 2, 1.0, -1.0)
        ratio[:12] = rng.normal(size=12)
        x = np.zeros((n, 12))
        for k, c in enumerate(chosen):
            x[k, c] = ratio[c]
        factor = 1 / np.linalg.norm(x, axis=1)
        x *= factor[:, None]
        rows = _Rows(np.concatenate(chosen), np.concatenate(([0], np.cumsum([len(c) for c in chosen]))), ratio, factor)
        weight, bias = _descend(rows, np.arange(n), y, cost, 20_000)
        alpha = exact_dual(x, y, cost)
        assert np.abs(weight[:12] - (alpha * y) @ x).max() < 1e-6 and abs(bias - alpha @ y) < 1e-6 and not weight[12:].any()


def test_ratios_and_scores_by_their_definition():
    texts, labels = [b"good words here", b"Bad bad bad", b"", b"good, bad x", b"here here words", b"BAD x!"], np.array([1, 0, 1, 0, 1, 0])
    model, sets = fit(texts, labels), [set(features([t])[1].tolist()) for t in texts]
    sides = [[1 + sum(f in s for s, y in zip(sets, labels, strict=True) if y == side) for f in set().union(*sets)] for side in (1, 0)]
    totals = [FEATURES - len(set().union(*sets)) + sum(side) for side in sides]
    ratio = {f: math.log(g / totals[0]) - math.log(b / totals[1]) for f, g, b in zip(set().union(*sets), *sides, strict=True)}
    assert all(abs(model.ratio[f] - r) < 1e-6 for f, r in ratio.items())
    for text, found in zip(texts, sets, strict=True):
        length = math.sqrt(sum(ratio[f] ** 2 for f in found)) or 1
        margin = model.bias + sum(ratio[f] / length * float(model.weight[f]) for f in found)
        assert abs(model.scores([text])[0] - 1 / (1 + math.exp(-model.slope * margin - model.offset))) < 1e-6


def test_the_fit_reads_features_as_it_reads_texts(spark):
    rows = [(k, f"word{k % 7} good{k % 3} " * (k % 50)) for k in range(60)] + [(60, None), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)], "doc_id long, quality int")
    order = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.xxhash64("doc_id", "text")).collect()
    want, got = fit([r.text.encode() for r in order], np.array([r.doc_id % 2 for r in order])), fit_quality(docs, labels)
    assert (want.weight == got.weight).all() and (want.ratio == got.ratio).all() and (want.bias, want.slope, want.offset) == (got.bias, got.slope, got.offset)
