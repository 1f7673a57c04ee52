"""Ordered funnel counting by filling candidate times backwards.

Attempts and candidate rows are united, sorted by client and time descending, and each candidate kind's
time is filled forward with last(ignore nulls): what an attempt then sees is the earliest later row of
that kind. A tag puts attempts before candidates of the same time, so later means strictly later. Each
step repeats this from the rows that the step before reached; attempts that meet at one row go on as one
with their number as weight.

A client may hold a third of all rows. Rows are therefore cut into ranges of (client, time) of bounded
size, and a fill works within one client's part of one range. What it misses is the first row of each
kind in the client's later ranges: a table of one row for each range and client that goes on after it,
which is at most as many rows as there are ranges. Times between steps are counted by value, and their
ranks are found in counts of 1024 slots a level, so no client's times meet in one group either.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import Scratch, lasting

#: Bits of a time that one level of the rank search tells apart.
LEVEL = 10


def _micros(span: Column) -> Column:
    day, hour, minute, second = (F.extract(F.lit(part), span) for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return ((day * 24 + hour) * 60 + minute).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")


def count_funnels(
    events: DataFrame, funnels: Mapping[str, tuple[Sequence[str], str]], within_micros: int = 15 * 60 * 1_000_000, share: int = 50, range_rows: int = 250_000, key: str = "client_id", kind: str = "kind", time: str = "ts"
) -> DataFrame:
    """funnel, client_id, n1.., deepest, t2.., same_depth for every funnel and client with attempts.

    `funnels`: name to (kinds of the steps, excluded kind); the step counts may differ, missing steps count 0. Each row of the first kind starts an attempt. Its next step is
    the client's earliest later row of the next kind; it is reached unless it comes over `within_micros` later or an excluded row
    lies after the previous step and not after it. n: attempts that reach a step; t: the ceil(`share` * n / 100)-th smallest time from the previous
    step in microseconds, null if none; deepest: the last step reached; same_depth: clients of the same funnel and deepest.
    Cases: rows with a null client, kind or time are left out; repeated rows count once; rows of one time are not after each other;
    a client without a first step has no row; an empty table gives no rows; further columns are ignored.
    """
    spark = events.sparkSession
    steps = max(len(kinds) for kinds, _ in funnels.values())
    used = sorted({k for kinds, out in funnels.values() for k in (*kinds, out)})
    names, going = list(funnels), [([used.index(k) for k in kinds], used.index(out)) for kinds, out in funnels.values()]  # kinds and funnels go by number
    rows = events.where(F.col(kind).isin(used)).select(F.col(key).alias("client"), _numbered(F.col(kind), used).alias("kind"), F.col(time).alias("at"))
    rows = rows.where(F.col("client").isNotNull() & F.col("at").isNotNull()).distinct()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // range_rows))
    with Scratch(spark) as scratch:
        rows = scratch.keep(rows.repartitionByRange(ranges, "client", "at").withColumn("part", F.spark_partition_id()))
        later = scratch.keep(_later(rows, len(used)))
        firsts = F.array(*(F.when(F.col("kind") == kinds[0], F.lit(i)) for i, (kinds, _) in enumerate(going)))
        attempts = rows.select("client", "part", "at", F.explode(F.array_compact(firsts)).alias("funnel"), F.lit(1).cast("long").alias("weight"))
        reached = [attempts.select("funnel", "client", F.lit(1).alias("step"), "weight")]
        times = []
        for step in range(2, steps + 1):
            now = {i: (kinds[step - 1], out) for i, (kinds, out) in enumerate(going) if len(kinds) >= step}
            found = scratch.keep(_step(attempts.where(F.col("funnel").isin(list(now))), rows, later, now, within_micros))
            reached.append(found.select("funnel", "client", F.lit(step).alias("step"), "weight"))
            times.append(found.select("funnel", "client", F.lit(step).alias("step"), "took", "weight"))
            attempts = found.groupBy("client", "part", "at", "funnel").agg(F.sum("weight").alias("weight"))
        counts = functools.reduce(DataFrame.unionByName, reached).select("*", F.lit(None).cast("long").alias("took"))
        if times:
            counts = counts.unionByName(_ranked(functools.reduce(DataFrame.unionByName, times), share, within_micros, scratch).select("*", F.lit(0).cast("long").alias("weight")))
        at = lambda i, what: F.when(F.col("step") == i, F.col(what))
        n = [F.coalesce(F.sum(at(i, "weight")), F.lit(0)).cast("long").alias(f"n{i}") for i in range(1, steps + 1)]
        t = [F.max(at(i, "took")).alias(f"t{i}") for i in range(2, steps + 1)]
        out = counts.groupBy("funnel", F.col("client").alias(key)).agg(*n, *t)
        deepest = F.greatest(*(F.when(F.col(f"n{i}") > 0, F.lit(i)).otherwise(F.lit(0)) for i in range(1, steps + 1)))
        out = scratch.keep(out.withColumn("deepest", deepest))
        alike = out.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))  # at most a row for each funnel and step
        out = out.join(F.broadcast(alike), ["funnel", "deepest"])
        return lasting(out.select(F.element_at(F.array(*map(F.lit, names)), F.col("funnel") + 1).alias("funnel"), key, *(f"n{i}" for i in range(1, steps + 1)), "deepest", *(f"t{i}" for i in range(2, steps + 1)), "same_depth"))


def _numbered(kind: Column, used: Sequence[str]) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(used)))


def _later(rows: DataFrame, kinds: int) -> DataFrame:
    """client, part, and for each kind the client's first row in a later range (at, part); a row only where there is one."""
    firsts = rows.groupBy("client", "part").agg(*(F.min(F.when(F.col("kind") == i, F.col("at"))).alias(f"_{i}") for i in range(kinds)))
    after = W.partitionBy("client").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    names = [f"later{i}" for i in range(kinds)]
    seen = [F.last(F.when(F.col(f"_{i}").isNotNull(), F.struct(F.col(f"_{i}").alias("at"), F.col("part"))), ignorenulls=True).over(after).alias(n) for i, n in enumerate(names)]
    return firsts.select("client", "part", *seen).where(F.coalesce(*names).isNotNull())


def _step(attempts: DataFrame, rows: DataFrame, later: DataFrame, going: Mapping[int, tuple[int, int]], within: int) -> DataFrame:
    """funnel, client, part and at of the row reached, took, weight: the attempts that get one step further."""
    kinds = sorted({k for pair in going.values() for k in pair})
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    candidates = rows.where(F.col("kind").isin(kinds)).select("client", "part", "at", "kind", none("funnel", "int"), none("weight", "long"), F.lit(1).alias("tag"))
    both = attempts.select("client", "part", "at", none("kind", "int"), "funnel", "weight", F.lit(0).alias("tag")).unionByName(candidates)
    back = W.partitionBy("client", "part").orderBy(F.desc("at"), "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    fill = [F.last(F.when(F.col("kind") == k, F.col("at")), ignorenulls=True).over(back).alias(f"near{k}") for k in kinds]
    seen = both.select("*", *fill).where("tag = 0").join(later, ["client", "part"], "left")
    here = lambda k: F.when(F.col(f"near{k}").isNotNull(), F.struct(F.col(f"near{k}").alias("at"), F.col("part")))
    first = {k: F.coalesce(here(k), F.col(f"later{k}")) for k in kinds}
    pick = lambda i: F.coalesce(*(F.when(F.col("funnel") == name, first[pair[i]]) for name, pair in going.items()))
    found = seen.select("funnel", "client", "at", "weight", pick(0).alias("next"), pick(1)["at"].alias("out")).where("next IS NOT NULL AND (out IS NULL OR out > next.at)")
    found = found.withColumn("took", _micros(F.col("next.at") - F.col("at"))).where(F.col("took") <= within)
    return found.select("funnel", "client", F.col("next.part").alias("part"), F.col("next.at").alias("at"), "took", "weight")


def _ranked(times: DataFrame, share: int, most: int, scratch: Scratch) -> DataFrame:
    """funnel, client, step, took: the ceil(share * n / 100)-th smallest of n times. A level counts slots of 2^shift microseconds, at most 2^LEVEL of them in the slot found before."""
    of = ["funnel", "client", "step"]
    counts = scratch.keep(times.groupBy(*of, "took").agg(F.sum("weight").alias("n")))
    shifts = range((max(most.bit_length() - 1, 0) // LEVEL) * LEVEL, -1, -LEVEL)
    found = None
    for shift in shifts:
        slots = counts.withColumn("slot", F.shiftright("took", shift))
        if found is not None:
            inside = found.select(*of, F.col("slot").alias("wide"), "rank")
            slots = slots.withColumn("wide", F.shiftright("took", shift + LEVEL)).join(inside, [*of, "wide"])
        sums = slots.groupBy(*of, "slot", *(["rank"] if found is not None else [])).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy(*of).orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow))
        if found is None:
            sums = sums.withColumn("rank", F.floor((F.sum("n").over(W.partitionBy(*of)) * share + 99) / 100))
        sums = sums.withColumn("upto", upto).where("rank <= upto AND rank > upto - n")
        found = sums.select(*of, "slot", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    return found.select(*of, F.col("slot").alias("took"))
