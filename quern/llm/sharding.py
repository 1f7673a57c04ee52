"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions only.

The published generator k = k * 2862933555777941757 + 1 (mod 2^64) is evaluated
in three limbs of 22, 22 and 20 bits: Spark's ANSI mode rejects a product that
overflows. Each round moves the candidate bucket upwards, so n rounds settle n shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import lasting

#: Fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
_LIMB = (1 << 22) - 1
_M0, _M1, _M2 = MULTIPLIER & _LIMB, (MULTIPLIER >> 22) & _LIMB, MULTIPLIER >> 44


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a 64-bit integer key; null keys count as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def bits(c: Column, shift: int, mask: int) -> Column:
        return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(mask).cast("long"))

    def step(acc: Column, _: Column) -> Column:
        low = acc["a"] * _M0 + 1
        mid = acc["a"] * _M1 + acc["b"] * _M0 + F.shiftright(low, 22)
        top = acc["a"] * _M2 + acc["b"] * _M1 + acc["c"] * _M0 + F.shiftright(mid, 22)
        a, b, c = bits(low, 0, _LIMB), bits(mid, 0, _LIMB), bits(top, 0, (1 << 20) - 1)
        high = F.shiftleft(c, 11).bitwiseOR(F.shiftright(b, 11))  # the upper 31 bits
        jump = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        moved = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), acc["j"].alias("s"), jump.alias("j"))
        return F.when(acc["j"] < shards, moved).otherwise(acc)

    start = F.struct(
        bits(key, 0, _LIMB).alias("a"), bits(key, 22, _LIMB).alias("b"), bits(key, 44, (1 << 20) - 1).alias("c"),
        F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("j"),
    )
    # after the last move j is past the end and s holds the shard
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda acc: acc["s"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_run: int = 50_000) -> DataFrame:
    """A shard and a gapless slot for every row of `docs`.

    The shard depends on the key and the shard count alone. Slots number each
    shard's rows from 0: rows fall into runs by hash, runs are numbered
    apart and start where the earlier runs of the shard end, so no
    shard is ever sorted in one task; the number of runs follows the row count.

    Cases: keys that are no whole numbers (strings, dates, ...) are hashed to 64 bits first; a null key counts as key 0 for the hash; a null text has size 1 and the
    checksum 0 of no bytes; equal rows take neighbouring slots, each its own;
    an empty table gives no rows; further columns are ignored. One shard more is
    returned as `grown_shard`: it equals `shard` or is the new shard.
    """
    whole = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col(key) if whole else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    rows = lasting(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
            jump_hash(number, shards).alias("shard"),
            jump_hash(number, shards + 1).alias("grown_shard"),
        )
    )
    runs = max(4, -(-rows.count() // (shards * rows_per_run)))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)))
    starts = (
        rows.groupBy("shard", "_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
        .drop("_n")
    )
    place = F.row_number().over(W.partitionBy("shard", "_run").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("_place", place.cast("long"))
        .join(starts, ["shard", "_run"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_place")).alias("slot"), "grown_shard")
    )
