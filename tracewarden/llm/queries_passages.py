"""op4: passages of 50 words or more that documents share."""

from pyspark.sql import DataFrame, SparkSession

from .passages import shared_passages


def op4_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_compact_window_passages": op4_compact_window_passages}
#: Min-hash candidates are no matter for SQL: tests hold them against brute force.
SQL: dict[str, str] = {}
