"""Verification of proposed anchors against the text, the policy and the fact pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_anchors(anchors: DataFrame, fields: DataFrame, values: DataFrame, min_confidence: float, max_accepted: int) -> DataFrame:
    """The anchors that hold, with their verified columns.

    ``anchors``: anchor_id, field_name, text, canonical, accepted (array), source, expected_source, source_text,
    match_type, confidence, start, end. ``fields``: field_name, label, protected. ``values``: the allowed
    (field_name, value), from the pool or already narrowed to a whitelist.

    An anchor holds if its source is the expected one, its field is in the policy, its text occurs in the source text
    (exactly or else ignoring case; inferred ones keep their span), a value of its own is allowed and its confidence
    is high enough. A canonical value that isn't allowed counts as an accepted one and so falls out; more than
    ``max_accepted`` values make it ambiguous; ``protected`` and ``label`` come from the policy. Nulls never hold.
    """
    exact = F.expr("locate(text, source_text)")
    at = F.when(exact > 0, exact).otherwise(F.expr("locate(lower(text), lower(source_text))")) - 1
    inferred = F.col("match_type") == "inferred"
    found = anchors.filter((F.col("source") == F.col("expected_source")) & (F.col("confidence") >= min_confidence)).withColumn("at", at)
    found = found.filter(inferred | (F.col("at") >= 0) & (F.length("text") > 0)).join(fields.select("field_name", "label", "protected"), "field_name")
    # Each proposed value meets the pool by an equi-join, so neither side grows with the other.
    named = F.concat(F.array(F.col("canonical")), F.coalesce("accepted", F.array().cast("array<string>")))
    proposed = found.select("anchor_id", "field_name", F.posexplode(named).alias("place", "value")).filter("value <> ''")
    held = proposed.join(values.select("field_name", "value").distinct(), ["field_name", "value"], "left_semi")
    kept = held.groupBy("anchor_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("value"))).alias("verified"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "value")))).alias("others"),
    )
    own = F.substr(F.col("source_text"), F.col("at") + 1, F.length("text"))
    return found.join(kept, "anchor_id").select(
        "anchor_id", "field_name", "label", F.when(inferred, F.col("text")).otherwise(own).alias("text"),
        F.when(inferred, F.col("start")).otherwise(F.col("at")).cast("int").alias("start"), F.when(inferred, F.col("end")).otherwise(F.col("at") + F.length("text")).cast("int").alias("end"),
        F.coalesce("verified", F.lit("")).alias("canonical"), F.col("others.value").alias("accepted"), "protected", "source", "confidence",
        F.when(F.size("others") > max_accepted, "ambiguous").otherwise(F.col("match_type")).alias("match_type"),
    )
