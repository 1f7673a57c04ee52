import collections
import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_packing import ODD, plain

from quern.llm import proportions
from quern.llm.proportions import Service, pack_mixture

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, source string, start int, window string"


def serve(totals, weights, unit):
    """The source of every token, one packet after the other."""
    heap = [(1.0 / w, s, 0) for s, w in enumerate(weights) if totals[s]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, s, k = heapq.heappop(heap)
        out += [s] * min(unit, totals[s] - k * unit)
        if (k + 1) * unit < totals[s]:
            heapq.heappush(heap, ((2.0 * (k + 1) + 1.0) / weights[s], s, k + 1))
    return np.array(out)


@pytest.mark.parametrize("totals, weights, unit", [([500, 3000, 7, 1200, 1], None, 32), ([900, 900, 900], [1, 2, 5], 7), ([1, 1, 1, 1], None, 1), ([40, 5000], [9, 1], 64), ([13], None, 5)])
def test_equals_serving_packet_by_packet(monkeypatch, totals, weights, unit):
    monkeypatch.setattr(proportions, "PACKETS", 37)
    monkeypatch.setattr(proportions, "CELLS", 400)
    weights = weights or totals
    order = serve(totals, weights, unit)
    service = Service(np.array(totals), np.array(weights), unit, 100)
    at = np.arange(len(order) + 1)
    assert (service.served(at) == np.array([np.bincount(order[:n], minlength=len(totals)) for n in at])).all()
    rng = np.random.default_rng(1)
    docs = []
    for s, total in enumerate(totals):
        cuts = np.unique([0, total, *rng.integers(0, total, total // 60)])
        docs += [(s, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    rng.shuffle(docs)
    source, start, length = np.array(docs).T
    row, inside, size, window, offset = service.place(source, start, length)
    sizes = [100] * (len(order) // 100) + [1 << b for b in range(7, -1, -1) if len(order) % 100 >> b & 1]
    ends = np.cumsum(sizes)
    assert (np.bincount(window, weights=size) == sizes).all()
    held = collections.defaultdict(list)
    for r, i, n, w, o in zip(row, inside, size, window, offset, strict=True):
        held[w].append((o, n, source[r], start[r] + i))
    for w, pieces in held.items():
        here = order[ends[w] - sizes[w] : ends[w]]
        at = 0
        for o, n, _, _ in sorted(pieces):
            assert o == at
            at += n
        # sources in order, each one's tokens in the queue's order and as many as were served
        assert [s for _, n, s, _ in sorted(pieces) for _ in range(n)] == sorted(here)
        for s in set(here):
            mine = [(q, n) for _, n, x, q in sorted(pieces) if x == s]
            first = int((order[: ends[w] - sizes[w]] == s).sum())
            assert [q + i for q, n in mine for i in range(n)] == list(range(first, first + int((here == s).sum())))
    assert len({(r, w) for r, w in zip(row, window, strict=True)}) == len(row)  # one piece of a document in a window


def test_deficits_stay_small():
    totals = np.array([4_000_000, 900_000, 1_000, 77, 2_500_000, 1_300_001])
    service = Service(totals, totals, 32, 2048)
    at = np.arange(0, totals.sum(), 2048)
    owed = at[:, None] * (totals / totals.sum()) - service.served(at)
    assert np.abs(owed).max() < 32 * 2
    steep = Service(totals, np.array([1, 2, 1, 1, 1, 1.0]), 32, 2048).served(np.arange(0, 200_001, 2048))
    assert np.abs(np.diff(steep, axis=0)[5:60, 1] - 2 * np.diff(steep, axis=0)[5:60, 0]).max() <= 96


@pytest.mark.parametrize("weights", [None, {"a": 3, None: 1.5}])
def test_round_trip(spark, weights):
    rows = [(i, t, "ab"[i % 2], 1, "x") for i, t in enumerate(ODD)] + [(0, "", "b", 1, "x"), (None, None, None, 1, "x"), (None, "x y z", None, 1, "x")] * 2 + [(100 + i, "word " * (i % 97), "aaac"[i % 4], 0, "") for i in range(300)]
    out = pack_mixture(spark.createDataFrame(rows, SCHEMA).repartition(3), weights, capacity=256, unit=8).collect()
    held = collections.defaultdict(list)
    for r in out:
        held[r.doc_id, r.source, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = collections.Counter()
    for key, text, source, *_ in rows:
        want[key, source, (*plain(text or ""), 1)] += 1
    left = collections.Counter()
    for (key, source, ids), times in want.items():
        pieces = collections.Counter(held[key, source, len(ids)])
        for start, length, crc in list(pieces):
            if crc != zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()):
                del pieces[start, length, crc]
        at = collections.Counter({0: times})
        for start, length, _ in sorted(pieces.elements()):
            assert at[start] > 0
            at[start] -= 1
            at[start + length] += 1
        assert +at == {len(ids): times}
        left[key, source, len(ids)] += sum(pieces.values())
    assert all(left[k] == len(v) for k, v in held.items())
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    total = sum(len(ids) * n for (_, _, ids), n in want.items())
    sizes = sorted((sum(n for _, n in x) for x in used.values()), reverse=True)
    assert sizes == [256] * (total // 256) + [1 << b for b in range(8, -1, -1) if total % 256 >> b & 1]
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


def test_empty(spark):
    assert pack_mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        pack_mixture(spark.createDataFrame([], SCHEMA), {"a": 0})
