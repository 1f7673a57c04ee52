import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.funnels import count_funnels
from quern.llm.queries import FUNNELS

START = datetime.datetime(2024, 3, 31, 1, 50)
SCHEMA = "client_id long, kind string, ts timestamp_ntz, part string, weight string, at int"


def brute(rows, funnels, within, share):
    """Every attempt followed row by row."""
    by = collections.defaultdict(set)
    for client, kind, ts, *_ in rows:
        if client is not None and kind is not None and ts is not None:
            by[client].add((ts, kind))
    micros = lambda d: d // datetime.timedelta(microseconds=1)
    out = {}
    for name, (kinds, bad) in funnels.items():
        for client, own in by.items():
            n, took = [0] * 4, [[] for _ in range(4)]
            for ts, kind in own:
                if kind != kinds[0]:
                    continue
                n[0] += 1
                for step in range(1, len(kinds)):
                    nexts = [t for t, k in own if k == kinds[step] and t > ts]
                    if not nexts or micros(min(nexts) - ts) > within or any(k == bad and ts < t <= min(nexts) for t, k in own):
                        break
                    n[step] += 1
                    took[step].append(micros(min(nexts) - ts))
                    ts = min(nexts)
            if n[0]:
                out[name, client] = (*n, max(i + 1 for i in range(4) if n[i]), *(sorted(t)[-(-share * len(t) // 100) - 1] if t else None for t in took[1:]))
    alike = collections.Counter((name, v[4]) for (name, _), v in out.items())
    return {k: (*v, alike[k[0], v[4]]) for k, v in out.items()}


def events(seed, n, span):
    """A hot client, ties, repeats, nulls, times on the limit, unknown kinds; a third of a second makes many rows share a time."""
    r = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    rows = []
    for _ in range(n):
        ts = START + datetime.timedelta(seconds=r.randrange(span) / 3, microseconds=r.choice((0, 0, 1)))
        rows.append((r.choice((7, 7, 7, 1, 2, 3, None)), r.choices(kinds, (5, 5, 3, 1, 1, 1, 1))[0], r.choice((ts,) * 20 + (None,)), "x", "y", 1))
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed, span, ranges, share", [(1, 9000, 40, 50), (2, 300, 25, 90), (3, 40000, 1000, 1)])
def test_equals_following_each_attempt(spark, seed, span, ranges, share):
    rows = events(seed, 500, span)
    limit = datetime.timedelta(minutes=15)
    rows += [(50, "view", START, "", "", 0), (50, "click", START + limit, "", "", 0), (51, "view", START, "", "", 0), (51, "click", START + limit + datetime.timedelta(microseconds=1), "", "", 0)]
    rows += [(52, "signup", START, "", "", 0), (52, "view", START + limit / 2, "", "", 0), (52, "error", START + limit / 2, "", "", 0), (53, "signup", START, "", "", 0), (53, "error", START, "", "", 0), (53, "view", START + limit, "", "", 0)]
    out = count_funnels(spark.createDataFrame(rows, SCHEMA).repartition(3), FUNNELS, share=share, range_rows=ranges).collect()
    got = {(r.funnel, r.client_id): (r.n1, r.n2, r.n3, r.n4, r.deepest, r.t2, r.t3, r.t4, r.same_depth) for r in out}
    assert len(got) == len(out)
    assert got == brute(rows, FUNNELS, 15 * 60 * 10**6, share)


def test_short_funnels_and_instants(spark):
    rows = [("a", "x", START), ("a", "y", START + datetime.timedelta(seconds=1)), ("b", "y", START)]
    frame = spark.createDataFrame(rows, "who string, what string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    out = count_funnels(frame, {"one": (("x",), "z"), "two": (("x", "y"), "z")}, within_micros=10**6, key="who", kind="what", time="at")
    assert sorted(map(tuple, out.collect())) == [("one", "a", 1, 0, 1, None, 1), ("two", "a", 1, 1, 2, 10**6, 1)]


def test_empty(spark):
    assert count_funnels(spark.createDataFrame([], SCHEMA), FUNNELS).count() == 0
