import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.packing import Encoder, pack, plan

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "a  b", "x\n\ny", " lead", "a\tb c", "don't it's 12 3a", "a\rb", "a \rb", "日本 語\nx <|endoftext|> y", "a  b", "a　b c", "x\x1c y", "é" * 9000, "w " * 30000, "tail\n"]


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def plain(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_remembered_words_give_the_tokenizers_ids():
    texts = ODD + ODD[::-1] + ["the of&&& and\nThe *** the"] * 3
    assert Encoder(PATH).encode(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]


def test_words_are_remembered_without_their_marks():
    encode = Encoder(PATH)
    texts = ["Wort Wort, Wort. Wort;\nWort &Wort d'été, x's. a.b,c 'sx, (Wort) \u00d7a \u00e9,\u00e9 e\u0301, e\u0301. \xa0Wort Wort\xad, \u0178l \u00df!"]
    assert encode.encode(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]
    start, end, kind, name, check = packing.units(b"\xffWort Wort, a.b\nWort\xff\xc3\xa9, Wort\xff")
    assert [(int(b - a), int(k)) for a, b, k in zip(start, end, kind)] == [(4, 2), (4, 0), (1, 2), (1, 0), (2, 2), (4, 1), (3, 2), (4, 0)]
    assert name[1] == name[7] and check[1] == check[7] and len(set(name.tolist())) == len(set(check.tolist())) == 7


def test_units_of_one_name_are_told_apart(monkeypatch):
    whole = packing.units
    monkeypatch.setattr(packing, "units", lambda buffer: (*(found := whole(buffer))[:3], found[3] & np.uint64(7) | np.uint64(1), found[4]))
    rng, encode = np.random.default_rng(5), Encoder(PATH)
    for _ in range(20):
        texts = [" ".join(rng.choice(["one", "two,", "drei", "vier.", "\u00e9t\u00e9", "x"], 5)) for _ in range(6)]
        assert encode.encode(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]


def test_words_stay_right_when_the_memory_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    rng, encode = np.random.default_rng(4), Encoder(PATH)
    parts, ends = ["don't", "it's", "été", "Word", "x", "12", "a-b", "×", "ß", "日本", "l'eau"], ["", ",", ".", "...", "?!", "'s", ".x", ",\n", ")", "\n"]
    for _ in range(60):
        texts = [" ".join(rng.choice(parts) + rng.choice(ends) + rng.choice(parts) + rng.choice(ends[:6]) for _ in range(8)) for _ in range(3)]
        assert encode.encode(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]


def test_round_trip(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(0, "", 0), (None, None, 1), (None, "x y z", 1)] + [(100 + i, "word " * (i % 97), 0) for i in range(400)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, rank int"), capacity=256, rows_per_run=20).collect()
    want = collections.Counter()
    for key, text, _ in rows:
        ids = [*plain(text or ""), 0]
        n = -(-len(ids) // 256)
        cuts = [0, *(len(ids) - 256 * (n - k) for k in range(1, n + 1))]
        for k in range(n):
            own = np.array(ids[cuts[k] : cuts[k + 1]], "<u4")
            want[key, k, cuts[k], len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) <= -(-sum(r.length for r in out) // 256) * 1.02 + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 10_000 - 1900)])
def test_plan_keeps_every_capacity(caps):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 90, 2000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    if caps[2] < 10_000:
        caps = (caps[0], caps[1], 8000)
    load = collections.defaultdict(lambda: np.zeros(3, int))
    ranks = collections.Counter()
    rows = plan(histogram, *caps, (1.0, 0.1, 0.1))
    ends = {}
    for length in histogram:
        mine = rows[rows[:, 0] == length]
        for (_, rank, each, first, offset), end in zip(mine, [*mine[1:, 1], histogram[length]], strict=True):
            assert ranks[length] == rank
            for r in range(rank, end):
                load[first + (r - rank) // each] += (length, 1, length * length)
            ranks[length] = end
    assert ranks == histogram and ends == {}
    assert all((x <= caps).all() for x in load.values())


@pytest.mark.parametrize("most_docs, most_cost", [(64, 64 * 64), (5, 64 * 64), (64, 900), (4, 1100)])
def test_the_plan_is_best_fit_piece_by_piece(most_docs, most_cost):
    rng = np.random.default_rng(most_docs + most_cost)
    lengths = np.sort(rng.integers(1, 31, 400))[::-1].tolist()
    scale, weights, open_ = np.array([64, most_docs, most_cost], float), (1.0, 0.7131, 0.3917), []
    for n in lengths:
        item, best = np.array([n, 1, n * n]), None
        for k, used in enumerate(open_):
            after = scale - used - item
            if (after >= 0).all() and (best is None or ((after / scale) ** 2 * weights).sum() < best[0] - 1e-12):
                best = (((after / scale) ** 2 * weights).sum(), k)
        if best is None:
            open_.append(item)
        else:
            open_[best[1]] = open_[best[1]] + item
    used = collections.defaultdict(lambda: np.zeros(3, int))
    for length, _, each, first, _, number in runs(plan(dict(collections.Counter(lengths)), 64, most_docs, most_cost, weights), lengths):
        for s in range(number):
            k = each if isinstance(each, int) else each[s]
            used[first + s] += k * np.array([length, 1, length * length])
    assert sorted(map(tuple, used.values())) == sorted(map(tuple, open_))


def runs(rows, lengths):
    """(length, first rank, pieces a sequence, first sequence, offset, sequences) of each row of a plan."""
    count = collections.Counter(lengths)
    for i, (length, rank, each, first, offset) in enumerate(rows.tolist()):
        after = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else count[length]
        yield length, rank, each, first, offset, (after - rank) // each


def test_weights_change_the_plan():
    histogram = {n: 50 + n * 7 % 13 for n in range(1, 40)}
    plans = [plan(histogram, 64, 64, 64 * 64, w).tobytes() for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1e-6, 100.0, 100.0))]
    assert len(set(plans)) == 3
