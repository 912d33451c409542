"""op1: a quality score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cotrain import score, train

KEEP = 0.5


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.withColumn("keep", F.col("score") >= KEEP)


QUERIES = {"op1_cotrained_quality": op1_cotrained_quality}
#: A trained model is no matter for SQL: tests check held-out accuracy.
SQL: dict[str, str] = {}
