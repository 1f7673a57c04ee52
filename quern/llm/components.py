"""Connected components of a link table by alternating large and small stars (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every greater neighbour of a node is joined to its least neighbour; small: every lesser one and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    joined = both.join(least, "a")  # a node of very many links is split by Spark's skew join
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root): each linked node and the least node that it reaches; it can be read until `scratch` ends.

    Cases: self links and nulls are ignored; repeated and mirrored links count once; without links there are no rows.
    Each round is written and the one before it deleted; a round that changes nothing ends the loop, after about log(diameter) of them.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        # all edges point to the lesser node; a forest of stars is the fixed point
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        before, edges = edges, scratch.keep(_star(_star(edges, True), False))
        scratch.drop(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return scratch.keep(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
