"""op9: a toxicity score for every document."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .toxicity import held_out, train

THRESHOLD = 0.3


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = spark.sparkContext.broadcast(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(batch.column("text")))], names=["doc_id", "score"])

    scored = pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_nnpu_toxicity": op9_nnpu_toxicity}
#: A trained model is no matter for SQL: tests check held-out accuracy.
SQL: dict[str, str] = {}
