"""Turns, facts and texts taken from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn for each order line: the question states the brand, the answer the type of its part and the size of the part
    whose key is the line's supplier."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("turn_id"), "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part")
    stated = part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_size").alias("other_size"))
    return rows.join(stated, "l_partkey").join(other, "l_suppkey", "left")


PART_TURNS_SQL = """
part_turns as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as turn_id, p.p_brand, p.p_type, p.p_size, o.p_size as other_size
  from lineitem join part p on p.p_partkey = l_partkey left join part o on o.p_partkey = l_suppkey)"""
