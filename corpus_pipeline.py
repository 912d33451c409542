"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import shared_dir
from tracewarden.llm.decontaminate import clean
from tracewarden.llm.jaccard import keep_one
from tracewarden.llm.mixing import apply_mix, mix
from tracewarden.llm.sharding import interleave
from tracewarden.llm.toxicity import reject

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels of a quarter of the rows are held out as in op9."""
    return reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity 0.8 or more."""
    return keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the cube-method mix of sources (weights 1, 2, 3, repeating) takes it."""
    return apply_mix(docs, mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): 24 shards that match the mixture."""
    return interleave(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near-copies", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: Training and seeded sampling are no matter for SQL: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/tracewarden/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs.withColumn("n_shards", F.lit(SHARDS))
