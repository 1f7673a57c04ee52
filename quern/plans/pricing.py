"""The minimum slice: one grouped aggregation over lineitem, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import table

PRICING_SQL = """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_quantity), 6) AS avg_qty,
       count(*) AS n_lines
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-08-01 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def pricing_summary(spark: SparkSession, root: str) -> DataFrame:
    """Sums by return flag and line status; the filter and six columns reach the scan."""
    lines = table(spark, root, "lineitem")
    return (
        lines.where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '2001-08-01 00:00:00'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
