"""Risk scores and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base scores by finding, weights of uniqueness, gain and confidence, level thresholds.
BASE = {"direct_protected_disclosure": 55.0, "direct_confidential_value_match": 55.0, "input_hypothesis_confirmation": 55.0, "input_output_slot_restoration": 55.0, "indirect_asset_restoration": 50.0, "indirect_protected_value_restoration": 40.0}
MATCH_WEIGHTS = {"exact": 1.0, "alias": 0.9, "semantic": 0.8, "partial": 0.65, "inferred": 0.7, "ambiguous": 0.45}
SEVERITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def base(decision: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in BASE.items():
        out = F.when(decision == name, value).otherwise(out)
    return out


def uniqueness(c_out: Column, k: int = 1) -> Column:
    return F.when((c_out > 0) & (c_out <= k), 1.0).when(c_out > 0, 1.0 / c_out).otherwise(0.0)


def gain(bits: Column) -> Column:
    return F.least(F.lit(1.0), bits / 3)


def total(base_score: Column, u: Column, g: Column, confidence: Column) -> Column:
    """Null without a base score."""
    whole = F.round(F.least(F.lit(100.0), base_score + 25 * u + 15 * g + 10 * F.least(F.lit(1.0), confidence)), 2)
    return F.when(base_score.isNotNull(), whole)


def level(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 45, "MEDIUM").when(score.isNotNull(), "LOW")


def match_weight(match_type: Column, weights: dict[str, float] | None = None) -> Column:
    """The policy's weight of a match type where it has weights, else the built-in one; 1 for types not listed."""
    out = F.lit(1.0)
    for name, value in (weights or MATCH_WEIGHTS).items():
        out = F.when(match_type == name, float(value)).otherwise(out)
    return out


def direct_score(c_out: Column, fields: Column, k: int = 1, weights: dict[str, float] | None = None) -> Column:
    """Score of a value found as it stands: 55, uniqueness, and the weight of an exact match where a field is named; no gain."""
    sure = F.when(fields > 0, match_weight(F.lit("exact"), weights)).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), 55 + 25 * uniqueness(c_out, k) + 10 * F.least(F.lit(1.0), sure)), 2)


def rollup(findings: DataFrame, key: list[str]) -> DataFrame:
    """(key.., findings, score, risk_level): the greatest score and the most severe level of each key's findings."""
    top = F.max_by("risk_level", severity(F.col("risk_level")))
    return findings.groupBy(*key).agg(F.count("*").alias("findings"), F.max("score").alias("score"), top.alias("risk_level"))


def severity(level_name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), level_name)
