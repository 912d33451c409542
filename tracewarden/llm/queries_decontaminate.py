"""op5: 10-word benchmark windows in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate


def op5_winnowed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op5_winnowed_overlap": op5_winnowed_overlap}
SQL = {
    "op5_winnowed_overlap": rf"""
with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark where text is not null),
bw as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct m from bw),
dw as (select r, m, i, array_to_string(w[i:i + m - 1], ' ') as g
       from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
hits as (select r, dw.m, i, item_id from dw join bw on dw.m = bw.m and dw.g = bw.g),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""
}
