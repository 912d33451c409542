"""Verification, rendering, version redaction, alias terms and diffs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.diff import text_diff
from ..operators import redact, render, verify
from ..sources import resources
from .tables import table

FIELDS = [("p_brand", "品牌", False), ("p_type", "类型", True)]


def anchor_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor for each part: its type in lower case, with its brand and type as values; expensive ones come from the wrong side."""
    part = table(spark, sf_dir, "part")
    anchors = part.select(
        F.col("p_partkey").alias("anchor_id"), F.lit("p_type").alias("field_name"), F.lower("p_type").alias("text"),
        F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name")).alias("canonical"), F.array("p_brand", "p_type").alias("accepted"),
        F.when(F.col("p_retailprice") > 1500, "output").otherwise("input").alias("source"), F.lit("input").alias("expected_source"),
        F.concat_ws(" ", "p_name", "p_type").alias("source_text"), F.lit("semantic").alias("match_type"), (F.col("p_size") / 50).alias("confidence"), F.lit(0).alias("start"), F.lit(0).alias("end"),
    )
    fields = spark.createDataFrame(FIELDS, "field_name string, label string, protected boolean")
    values = part.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f, *_ in FIELDS])).alias("v")).select("v.*").distinct()
    out = verify.verify_anchors(anchors, fields, values, 0.3, 3)
    return out.select("anchor_id", "field_name", "label", "text", "start", "end", "canonical", F.array_join("accepted", "|").alias("accepted"), "protected", "match_type")


VERIFIED = """
with t as (select *, p_name || ' ' || p_type as body, lower(p_type) as low from part where p_size / 50.0 >= 0.3 and p_retailprice <= 1500),
u as (select *, case when strpos(body, low) > 0 then strpos(body, low) else strpos(lower(body), low) end as pos from t)
select p_partkey as anchor_id, 'p_type' as field_name, '类型' as label, substr(body, pos, length(low)) as text, cast(pos - 1 as integer) as start, cast(pos - 1 + length(low) as integer) as "end",
  case when p_size > 25 then p_type else '' end as canonical, p_type as accepted, true as protected, 'semantic' as match_type from u
"""


def fact_pool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"p_brand": (F.col("p_brand"), "品牌"), "p_type": (F.col("p_type"), "类型"), "p_size": (F.col("p_size"), "尺寸")}
    return table(spark, sf_dir, "part").select("p_partkey", render.fact_line(F.col("p_partkey"), F.col("p_name"), fields).alias("line"))


POOL_LINES = "select p_partkey, concat('  [', p_partkey, '] ', coalesce(p_name, ''), '，品牌=' || p_brand, '，类型=' || p_type, '，尺寸=' || p_size) as line from part"


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand a rule: its types imply the largest size."""
    rules = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.max("p_size").cast("string").alias("size"))
    return rules.select("p_brand", render.rule_line(F.col("p_brand"), F.lit("p_type"), F.col("types"), F.create_map(F.lit("p_size"), F.col("size"))).alias("line"))


RULE_LINES = "select p_brand, concat('- ', p_brand, '：当 p_type 为 ', string_agg(distinct p_type, ', ' order by p_type), ' 时，p_size = ', max(p_size)) as line from part group by 1"


def answer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    pick = render.select_answer(F.col("event_type") == "error", F.col("value") > 100, F.col("value") > 50, F.lit("safe"), F.coalesce("props", F.lit("")))
    return rows.select("event_id", pick.alias("x")).select("event_id", "x.answer", "x.label")


ANSWERS = """
select event_id, case when event_type = 'error' then coalesce(props, '') else 'safe' end as answer,
  case when event_type = 'error' and value > 100 then 'fallback' when event_type = 'error' then 'secondary_safe_answer' when value > 50 then 'cfa_safe_answer' else 'raw_answer' end as label from events
"""


def version_fuzzing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: the answer cites a version with and without its product, and its family."""
    v = F.concat_ws(".", "p_size", F.lit("4"), "p_size")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", v).alias("term"), F.concat("p_name", F.lit("-v"), v, F.lit("; v"), v, F.lit("; "), "p_size", F.lit(".4 系列; "), v, F.lit("0")).alias("answer"))
    return part.select("p_partkey", redact.fuzz_version(F.col("answer"), F.col("term")).alias("redacted"))


VERSIONS = "select p_partkey, concat('X; X; X; ', p_size, '.4.', p_size, '0') as redacted from part"


def alias_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = resources.alias_terms(F.col("text"), F.lit(None).cast("array<string>"), F.regexp_extract("text", r"^(\w+ \w+)", 1), F.regexp_extract("text", r"^([^.]*\.)", 1))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms).alias("term"))


ALIASES = r"""
with t as (select item_id, unnest(string_split(regexp_extract(text, '^(\w+ \w+)', 1), ' ')) as term, 2 as least, 1000000 as most from benchmark
  union all select item_id, regexp_extract(text, '^([^.]*\.)', 1), 4, 1000000 from benchmark
  union all select item_id, unnest(regexp_split_to_array(text, '[，。；;、：:\n]+')), 4, 60 from benchmark)
select distinct item_id, trim(term) as term from t where length(trim(term)) between least and most
"""


def turn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a conversation keeps, drops and adds against the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return turns.select("conv_id", "turn", before.alias("old"), F.col("text").alias("new")).select("conv_id", "turn", text_diff("old", "new").alias("segments"))


QUERIES = {f.__name__: f for f in (anchor_verification, fact_pool_lines, rule_lines, answer_selection, version_fuzzing, alias_generation, turn_diff)}
SQL = {"anchor_verification": VERIFIED, "fact_pool_lines": POOL_LINES, "rule_lines": RULE_LINES, "answer_selection": ANSWERS, "version_fuzzing": VERSIONS, "alias_generation": ALIASES}
