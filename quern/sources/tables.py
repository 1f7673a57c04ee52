from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`; any store that Spark can read will do."""
    return spark.read.parquet(f"{root}/{name}.parquet")
