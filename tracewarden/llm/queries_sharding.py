"""op6: all documents into 24 shards by proportional stratified interleaving."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import interleave

SHARDS = 24


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_interleaved_shards": op6_interleaved_shards}
#: DuckDB has no CRC-32, so the whole result is held against a brute-force version in tests/llm instead.
SQL: dict[str, str] = {}
