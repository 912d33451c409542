"""Audit records and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record(results: DataFrame, keys: list[str]) -> DataFrame:
    """Turn results with the texts replaced by their SHA-256."""
    return results.select(*keys, F.sha2(F.coalesce("user_input", F.lit("")), 256).alias("user_input_hash"), F.sha2(F.coalesce("model_output", F.lit("")), 256).alias("llm_output_hash"), *[c for c in results.columns if c not in {*keys, "user_input", "model_output"}])


def append(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)
