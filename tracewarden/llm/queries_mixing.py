"""op7: all documents mixed to source weights 1, 2, 3, repeating."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import mix


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op7_cube_mix": op7_cube_mix}
#: Balanced sampling is random with a seed: totals and bounds are tested in tests/llm instead.
SQL: dict[str, str] = {}
