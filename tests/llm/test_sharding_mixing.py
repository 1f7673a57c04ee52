import collections
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.mixing import mix_documents, mixed, source_targets
from quern.llm.sharding import jump_hash, shard_documents


def jump(key, n):
    last, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        last, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, *range(500)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        got = dict(rows.select("k", jump_hash(F.col("k"), n).alias("s")).collect())
        assert got == {k: jump(k, n) for k in keys}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, _run int")


ODD = [(1, "a b", "en", "s", 3, 0, 0), (1, "a b", "en", "s", 3, 0, 0), (None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, 1), (3, "é " * 5000, "fr", "t", 1, 1, 1), (4, " \t\n", "fr", "t", 1, 1, 1), (1, "c", "en", "u", 1, 0, 0)]


def test_shards_hold_every_row_and_slots_have_no_gap(spark):
    rows = shard_documents(documents(spark, ODD), rows_per_run=1).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted((d[0] or -1, len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in ODD)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(documents(spark, [])).count() == 0


def fill(sizes):
    """The excess of capped sources reshared until none is above: the loop in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 3}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1000, "d": 2, "e": 900}, {"a": 5}, {chr(97 + i): 7**i for i in range(9)}, {f"s{i}": (i * 7919) % 1000 for i in range(300)}])
def test_targets_equal_the_loop(spark, sizes):
    with Scratch(spark) as scratch:
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3), scratch).collect()
    assert {r.source: pytest.approx(r.target) for r in rows} == fill(sizes)


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), "en", "src" + str(i % 7 if i % 3 else 0), 1, 0, 0) for i in range(3000)]
    out = mix_documents(documents(spark, rows)).collect()
    again = mix_documents(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert sorted(r.doc_id for r in out) == list(range(3000))
    taken, target = collections.Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 2 for s in target)
    text = mixed(documents(spark, rows))
    assert text.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "_run"]
    assert collections.Counter(r.doc_id for r in text.collect()) == collections.Counter({r.doc_id: r.copies for r in out if r.copies})


def test_mix_of_odd_rows(spark):
    out = mix_documents(documents(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r.taken <= 3 * r["size"] for r in out)
    assert {r.source: r.source_size for r in out} == {"s": 4, None: 0, "t": 5000, "u": 1}
    assert mixed(documents(spark, ODD)).count() == sum(r.copies for r in out)
    assert mix_documents(documents(spark, [])).count() == 0


def test_keys_of_any_type_are_sharded(spark):
    rows = spark.createDataFrame([(f"https://host/{i}", "a") for i in range(400)] + [(None, "b")], "doc_id string, text string")
    out = shard_documents(rows).collect()
    assert len(out) == 401 and all(r.grown_shard in (r.shard, 16) for r in out)
    assert min(collections.Counter(r.shard for r in out).values()) > 8 and [r.shard for r in out if r.doc_id is None] == [jump(0, 16)]


def test_rounding_alone_comes_near_and_keeps_every_probability(spark):
    sizes = [1 + i * i * 37 % 211 for i in range(120)] + [900, 700, 800]
    rows = documents(spark, [(i, "w " * n, "en", "ab"[i % 2], 1, 0, 0) for i, n in enumerate(sizes)]).cache()
    drawn, runs = collections.Counter(), 40
    for seed in range(runs):
        taken = collections.Counter()
        for r in mix_documents(rows, seed=seed, corrections=0).collect():
            share = r.target / r.source_size
            assert int(share) <= r.copies <= int(share) + 1
            drawn[r.doc_id] += r.copies - int(share)
            taken[r.source] += r.taken
            target = {**(target if taken.total() != r.taken else {}), r.source: r.target}
        assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    for i in range(len(sizes)):
        p = target["ab"[i % 2]] / sum(n for j, n in enumerate(sizes) if j % 2 == i % 2) % 1
        assert abs(drawn[i] - runs * p) <= 4.5 * (runs * p * (1 - p)) ** 0.5


def test_clashing_columns_are_passed_on(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), f"s{i % 3}", 100 + i, -1, "k", 5.0, None) for i in range(200)], "doc_id long, text string, source string, _size long, _n int, _k string, _row double, c0 string")
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert all(r._size == 100 + r.doc_id and r._n == -1 and r._k == "k" and r._row == 5.0 and r.c0 is None for r in out.collect())
