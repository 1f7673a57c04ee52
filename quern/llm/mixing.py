"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document has an expected number of copies, target over source size. Its
whole part is certain; the fractions are rounded by the pivotal method (Deville
and Tille) with words as the mass: two fractional units meet, and words move at random
from one to the other until one of them is integral; the other goes on. Every document keeps its probability, and
the words of the two stay what they were.

Long documents, those of over 1/LONG of their source, first meet all the rest of their source as one unit, the longest first:
the rest's common fraction takes up what they win or lose. Then duels run inside blocks of some 64 documents of
one source and like size; the one residual of each block goes to the
next level, a tree whose depth grows with the logarithm of the row count, and what is left of a
source is one document's fraction. A gap remains where a document outweighs what the rest of its source can take
up; it is closed by moving at most `corrections` documents a source by one copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import WORD, Scratch, lasting, small, uniform

BLOCK = 64
#: A source holds fewer than this many long documents.
LONG = 2000
_EPS = 1e-9
_BROADCAST_ROWS = 20_000


def _weighed(sizes: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """`sizes` with _weight: the weights repeat over the sources in code point order, null last. Sources are numbered by sorted partitions, not in one task."""
    placed = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.keep(placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return placed.join(F.broadcast(before), "_part").select("source", "source_size", weight.alias("_weight"))


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with `target` added: weights repeat over the sources in code point order, null last.

    Targets share the sum of all sizes by weight. A target stops at `most` times its source's size;
    what it leaves is shared by weight among the others, until none is above. Each round of that is one
    aggregation of three numbers; the level only rises, and rounds end when no further source is capped.
    """
    known = scratch.keep(_weighed(sizes, weights, scratch))
    cap = F.col("source_size") * F.lit(float(most))
    level, last = None, -1
    while True:
        capped = F.lit(False) if level is None else cap <= F.lit(level) * F.col("_weight")
        now = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, cap)).alias("kept"), F.sum(F.when(~capped, F.col("_weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if now["n"] == last or not now["open"]:
            break
        last, level = now["n"], ((now["all"] or 0) - (now["kept"] or 0.0)) / now["open"]
    return known.select("source", "source_size", F.least(cap, F.lit(level if level is not None else 0.0) * F.col("_weight")).alias("target"))


def _duel(acc: Column, x: Column) -> Column:
    """One pivotal step between the carried unit and the next one of the block: words move from one to the other until one is integral."""
    c, s, t = acc["c"], acc["c"]["unit"]["size"], x["unit"]["size"]
    up = F.least((1 - c["p"]) * s, x["p"] * t)  # words that c can win, and lose
    down = F.least(c["p"] * s, (1 - x["p"]) * t)
    wins = x["u"] * (up + down) < down
    moved = F.when(wins, up).otherwise(-down)
    ends = F.when(wins, (1 - c["p"]) * s <= x["p"] * t).otherwise(c["p"] * s <= (1 - x["p"]) * t)  # whether c is the one that becomes integral

    def carried(who: Column, p: Column) -> Column:
        return F.struct(who["unit"].alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), who["u"].alias("u"))

    def state(carry: Column, who: Column, take: Column) -> Column:
        return F.struct(carry.alias("c"), F.concat(acc["out"], F.array(F.struct(who["unit"].alias("unit"), take.cast("int").alias("take")))).alias("out"))

    first = F.struct(x.alias("c"), acc["out"].alias("out"))  # nothing carried yet
    settled = (c["p"] <= _EPS) | (c["p"] >= 1 - _EPS)
    return (
        F.when(c["unit"].isNull(), first)
        .when(settled, state(x, c, F.round(c["p"])))
        .when(ends, state(carried(x, x["p"] - moved / t), c, wins))
        .otherwise(state(carried(c, c["p"] + moved / s), x, ~wins))
    )


def _meet_the_rest(units: DataFrame, same: list[str], seed: int) -> DataFrame:
    """Each source's long documents, longest first, decided against the rest of the source -> same, p (the fraction left to all others), out.

    Fewer than LONG documents of a source are long, so their list is bounded.
    """
    kind = units.schema["unit"].dataType.simpleString()
    drawn = [uniform(F.col("unit.h"), F.lit(seed), F.lit(salt)).alias(name) for salt, name in ((-3, "u"), (-4, "v"))]
    entry = F.struct((-F.col("unit.size")).alias("size"), F.col("unit.h").alias("h"), F.struct("unit", *drawn).alias("x"))
    long = units.groupBy(*same, "p").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias("_entries"))

    def step(acc: Column, x: Column) -> Column:
        p, s = acc["p"], x["unit"]["size"]
        rest = acc["rest"] - s
        up, down = F.least((1 - p) * s, p * rest), F.least(p * s, (1 - p) * rest)
        moved = F.when(x["u"] * (up + down) < down, up).otherwise(-down)
        own = p + moved / s  # 0 or 1 unless the rest could not take up more
        take = (x["v"] < F.round(own, 9)).cast("int")
        after = F.when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - moved / F.greatest(rest, F.lit(1))))).otherwise(p)
        return F.struct(after.alias("p"), rest.alias("rest"), F.concat(acc["out"], F.array(F.struct(x["unit"].alias("unit"), take.alias("take")))).alias("out"))

    start = F.struct(F.col("p").alias("p"), F.col("source_size").alias("rest"), F.array().cast(f"array<struct<unit:{kind},take:int>>").alias("out"))
    return long.select(*same, F.aggregate("_entries", start, step).alias("_f")).select(*same, "_f.p", "_f.out")


def _fold(units: DataFrame, keys: list[str], seed: int, level: int) -> DataFrame:
    """Each block's units, the longest first -> keys, the carried unit `c` and `out`, the decided ones."""
    kind = units.schema["unit"].dataType
    entry = F.struct((-F.col("unit.size")).alias("size"), F.col("unit.h").alias("h"), F.struct("unit", "p", uniform(F.col("unit.h"), F.lit(seed), F.lit(level)).alias("u")).alias("x"))
    start = F.struct(
        F.struct(F.lit(None).cast(kind).alias("unit"), F.lit(0.0).alias("p"), F.lit(0.0).alias("u")).alias("c"),
        F.array().cast(f"array<struct<unit:{kind.simpleString()},take:int>>").alias("out"),
    )
    block = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"])
    return units.groupBy(*keys).agg(block.alias("_entries")).select(*keys, F.aggregate("_entries", start, _duel).alias("_f")).select(*keys, "_f.c", "_f.out")


def mix_units(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 7, corrections: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, rows, source_size, target, copies: one row for each distinct (doc_id, source, size).

    `rows` input rows are alike and share `copies`; size is the number of words.
    Cases: null text has size 0; null source is a source of its own, ranked last; a source without
    words has target 0 and is not taken; repeated rows share their copies evenly, the first ones one more;
    an empty table gives no rows; further columns are ignored; the result depends on the rows, `seed` and nothing else.
    """
    with Scratch(docs.sparkSession) as scratch:
        return lasting(_mixed_units(docs, weights, most, seed, corrections, key, text, source, scratch))


def _mixed_units(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int, corrections: int, key: str, text: str, source: str, scratch: Scratch) -> DataFrame:
    alike = ["doc_id", "source", "size"]
    rows = scratch.keep(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .groupBy(*alike)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    targets = scratch.keep(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), scratch, weights, most))
    known = small(targets.withColumnRenamed("source", "_source"), _BROADCAST_ROWS)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(share + _EPS)
    same = ["source", "source_size", "target"]
    units = (
        rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        .join(known, rows["source"].eqNullSafe(known["_source"]))
        .select(*same, F.struct("doc_id", "size", "rows", "nth", whole.cast("long").alias("whole"), F.xxhash64(*alike, "nth").alias("h")).alias("unit"), F.greatest(F.lit(0.0), share - whole).alias("p"))
    )

    def drawn(rest: DataFrame, salt: int) -> DataFrame:
        return rest.select(*same, F.col("unit"), (uniform(F.col("unit.h"), F.lit(seed), F.lit(salt)) < F.col("p")).cast("int").alias("take"))

    open_ = (F.col("p") > _EPS) & (F.col("unit.size") > 0)
    long = F.col("unit.size") * F.lit(LONG) > F.col("source_size")
    settled = [drawn(units.where(~open_), -2)]  # without words, or without a fraction
    met = scratch.keep(_meet_the_rest(units.where(open_ & long), same, seed))
    settled.append(met.select(*same, F.inline("out")))
    changed = small(met.select(F.col("source").alias("_s"), F.col("p").alias("_p")), _BROADCAST_ROWS)
    others = units.where(open_ & ~long).join(changed, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("p", F.coalesce("_p", "p")).drop("_s", "_p")
    settled.append(drawn(others.where(F.col("p") <= _EPS), -2))
    open_ = F.col("p") > _EPS
    left, level, bins = others.where(open_), 0, F.floor(F.log2(F.col("unit.size") + 1) * 4).cast("int")
    while True:
        left = left.withColumn("_bin", bins)
        sums = scratch.keep(left.groupBy("source", "_bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("_blocks")))
        most_blocks = sums.agg(F.max("_blocks")).first()[0]
        if most_blocks is None:
            break
        sums = small(sums.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_blocks"), _BROADCAST_ROWS)
        dealt = left.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).withColumn("_block", F.pmod(F.xxhash64("unit.h", F.lit(seed), F.lit(level)), F.col("_blocks")))
        folded = scratch.keep(_fold(dealt, [*same, "_bin", "_block"], seed, level))
        settled.append(folded.select(*same, F.inline("out")))
        left, level = folded.select(*same, F.col("c.unit").alias("unit"), F.col("c.p").alias("p")), level + 1
        if most_blocks == 1:  # at most one residual is left for each size class: the root of each source
            folded = scratch.keep(_fold(left, same, seed, level))
            settled.append(folded.select(*same, F.inline("out")))
            settled.append(drawn(folded.select(*same, F.col("c.unit").alias("unit"), F.round(F.col("c.p"), 9).alias("p")), -1))
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = out.groupBy("unit.doc_id", "source", "unit.size", "unit.rows", "source_size", "target").agg(F.sum(F.col("unit.whole") + F.col("take")).alias("copies"))
    out = scratch.keep(out.select("doc_id", "source", "size", "rows", "source_size", "target", "copies"))
    for _ in range(corrections):
        out = _corrected(out, most, scratch)
    return out


def _corrected(units: DataFrame, most: float, scratch: Scratch) -> DataFrame:
    """One copy more or less of the one document of each source whose size best closes the gap that rounding left.

    A few very long documents decide a small source's words; rounding alone keeps their number right, not their words.
    """
    gaps = units.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_gap"))
    gaps = small(scratch.keep(gaps), _BROADCAST_ROWS)
    may = F.when(F.col("_gap") > 0, F.col("copies") + 1 <= F.lit(most) * F.col("rows")).otherwise(F.col("copies") > 0)
    after = F.abs(F.abs("_gap") - F.col("size"))
    best = F.min(F.struct(after.alias("after"), F.xxhash64("doc_id", "size").alias("h"), "doc_id", "size", F.signum("_gap").cast("long").alias("step")))
    moves = units.join(gaps, F.col("source").eqNullSafe(F.col("_s"))).where(may & (F.col("size") > 0) & (after < F.abs("_gap"))).groupBy("source").agg(best.alias("_m"))
    moves = small(scratch.keep(moves.select(F.col("source").alias("_s"), F.col("_m.doc_id").alias("_k"), F.col("_m.size").alias("_z"), F.col("_m.step").alias("_step"))), _BROADCAST_ROWS)
    found = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("size") == F.col("_z"))
    return units.join(moves, found, "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_s", "_k", "_z", "_step")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words), source, copies. See mix_units for the cases."""
    each = mix_units(docs, **options).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("_row") < F.pmod(F.col("copies"), F.col("rows"))).cast("long")
    return each.withColumn("copies", own.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the columns and rows of `docs`, each row as often as it is taken.

    Cases: those of mix_units; columns of any other name are passed on as they are.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t, s = (f"c{docs.columns.index(c)}" for c in (key, text, source))
    units = mix_units(plain, key=k, text=t, source=s, **options).select(F.col("doc_id").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("rows").alias("_rows"), F.col("copies").alias("_copies")).where("_copies > 0")
    rows = plain.withColumn("_size", F.coalesce(F.regexp_count(F.col(t), F.lit(WORD)), F.lit(0)).cast("long"))
    found = rows.join(units, F.col(k).eqNullSafe(F.col("_k")) & F.col(s).eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    # alike rows share their copies: numbered within what is alike, the first ones take one more
    alone = found.where("_rows = 1").withColumn("_row", F.lit(1))
    shared = found.where("_rows > 1").withColumn("_row", F.row_number().over(W.partitionBy("_k", "_s", "_z").orderBy(F.xxhash64(t), *[c for c, kind in plain.dtypes if "map<" not in kind])))
    n = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_row") <= F.pmod(F.col("_copies"), F.col("_rows"))).cast("long")
    return alone.unionByName(shared).withColumn("_n", n.cast("int")).where("_n > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*plain.columns).toDF(*docs.columns)
