"""What a generator returns: JSON in free text, and anchors in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_TYPES = ["exact", "alias", "semantic", "partial", "inferred", "ambiguous"]
ANCHORS = "struct<anchors:array<struct<field_name:string,source_text:string,confidence:string,match_type:string,canonical_value:string,accepted_values:array<string>,reason:string>>>"


def json_object(raw: Column) -> Column:
    """The text of the JSON object in an answer: the whole of it, a fenced block, or from the first to the last brace; else null."""
    body = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(x.startswith("{") & F.from_json(x, "map<string,string>").isNotNull() & F.get_json_object(x, "$").isNotNull(), x) for x in (body, fenced, braces)])


def parse(raw: Column, schema: str = ANCHORS) -> Column:
    return F.from_json(json_object(raw), schema)


def confidence(value: Column) -> Column:
    """A number between 0 and 1; what is none counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))))


def semantic_anchors(answers: DataFrame, whitelist: DataFrame, fields: list[str], threshold: float, most: int, key: list[str]) -> DataFrame:
    """Anchors that a generator proposed for a segment and that hold.

    ``answers``: key.., source, text, llm_json. ``whitelist``: (key.., field_name, value) recalled for the same segment.
    A proposal holds if its field is in the policy, its evidence occurs in the segment (exactly or else ignoring case),
    its confidence reaches the threshold and a value of it was recalled. Unknown match types are ambiguous; at most
    ``most`` accepted values stay, in their order. The source is the segment's own, whatever the answer says.
    """
    rows = answers.select(*key, "source", "text", F.posexplode(parse(F.col("llm_json"))["anchors"]).alias("place", "a"))
    evidence = F.trim(F.coalesce("a.source_text", F.lit("")))
    rows = rows.select(
        *key, "source", "text", "place", F.trim("a.field_name").alias("field_name"), evidence.alias("evidence"), confidence(F.col("a.confidence")).alias("confidence"),
        F.when(F.col("a.match_type").isin(MATCH_TYPES), F.col("a.match_type")).when(F.col("a.match_type").isNull(), "semantic").otherwise("ambiguous").alias("match_type"),
        F.concat(F.array(F.trim(F.coalesce("a.canonical_value", F.lit("")))), F.transform(F.coalesce("a.accepted_values", F.array().cast("array<string>")), lambda v: F.trim(v))).alias("values"),
        F.trim(F.coalesce("a.reason", F.lit(""))).alias("reason"),
    )
    exact = F.expr("locate(evidence, text)")
    at = F.when(exact > 0, exact).otherwise(F.expr("locate(lower(evidence), lower(text))")) - 1
    rows = rows.withColumn("start", at).filter((F.col("evidence") != "") & (F.col("start") >= 0) & (F.col("confidence") >= threshold) & F.col("field_name").isin(fields))
    own = [*key, "source", "place"]
    named = rows.select(*own, "field_name", F.posexplode("values").alias("i", "value")).filter("value <> ''")
    kept = named.join(whitelist.select(*key, "field_name", "value").distinct(), [*key, "field_name", "value"], "left_semi")
    kept = kept.groupBy(*own, "value").agg(F.min(F.when(F.col("i") > 0, F.col("i"))).alias("i"), F.max((F.col("i") == 0).cast("int")).alias("first"))
    kept = kept.groupBy(*own).agg(F.max(F.when(F.col("first") == 1, F.col("value"))).alias("canonical"), F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "value")))).alias("accepted"))
    return rows.join(kept, own).select(
        *key, "source", "place", "field_name", F.substr("text", F.col("start") + 1, F.length("evidence")).alias("text"), F.coalesce("canonical", F.lit("")).alias("canonical"),
        F.slice(F.col("accepted.value"), 1, most).alias("accepted"), "start", (F.col("start") + F.length("evidence")).alias("end"), "confidence", "match_type", (F.col("match_type") == "inferred").alias("inferred"), "reason",
    )


def selection(raw: Column) -> Column:
    """A generator's choice of units: (needs_internal_kb, content_units_to_load); null where there is no JSON object."""
    return F.from_json(json_object(raw), "struct<needs_internal_kb:boolean,content_units_to_load:array<struct<kb_id:string,unit_ids:array<string>>>,confidence:double>")
