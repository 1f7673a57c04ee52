"""quern: a small PySpark-first analytics engine over Parquet tables."""
