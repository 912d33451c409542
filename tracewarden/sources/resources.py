"""Snapshots of configuration files, and alias terms of imported facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of configuration files; whole files are read, so this is not for data."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def alias_terms(content: Column, paraphrases: Column, keywords: Column, summary: Column) -> Column:
    """Terms that stand for a content, in order and without repeats: paraphrases, keywords of two letters or more, a
    summary of four or more, and clauses of the content of 4 to 60. Nulls give nothing."""
    none = F.array().cast("array<string>")
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    trimmed = lambda terms: F.transform(F.coalesce(terms, none), strip)
    clauses = F.filter(trimmed(F.split(content, "[，。；;、：:\n]+")), lambda t: F.length(t).between(4, 60))
    words = F.filter(trimmed(F.split(keywords, "[ ,，;；]+")), lambda t: F.length(t) >= 2)
    told = F.filter(trimmed(F.array(summary)), lambda t: F.length(t) >= 4)
    return F.array_distinct(F.filter(F.concat(trimmed(paraphrases), words, told, clauses), lambda t: F.coalesce(t, F.lit("")) != ""))
