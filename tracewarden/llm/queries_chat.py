"""op8: all conversations as preference pairs: even ids are chosen, the odd ids after them rejected."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import END, START, conversations, preferences


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    even = F.coalesce(F.pmod("conv_id", F.lit(2)) == 0, F.lit(True))
    sides = convs.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), even.alias("even"), "conv_id", "turns")
    first = lambda cond, col: F.first(F.when(cond, F.col(col)), ignorenulls=True)
    pairs = sides.groupBy("pair_id").agg(
        first(F.col("even"), "conv_id").alias("chosen_id"), first(~F.col("even"), "conv_id").alias("rejected_id"),
        first(F.col("even"), "turns").alias("chosen"), first(~F.col("even"), "turns").alias("rejected"),
    )
    show = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = preferences(pairs)
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("prefix_turns").cast("long").alias("prefix_turns"), "prompt", "chosen_completion", "rejected_completion", show("chosen_spans").alias("chosen_spans"), show("rejected_spans").alias("rejected_spans"), "usable")


def _sql() -> str:
    turn = f"'{START}' || role || chr(10) || text || '{END.strip()}' || chr(10)"

    def side(name: str, parity: int) -> str:
        return f"""
{name}_t as (select p, i, s, role, sum(length(s)) over (partition by p order by i) as e, length(text) + {len(END)} as n
  from t left join lcp using (p) where par = {parity} and i > coalesce(k, 0)),
{name} as (select p, string_agg(s, '' order by i) as c, coalesce(string_agg(case when role = 'assistant' then cast(e - n as bigint) || '-' || cast(e as bigint) end, ',' order by i), '') as m from {name}_t group by p)"""

    return f"""
with t0 as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i from conversations),
t as (select *, conv_id // 2 as p, conv_id % 2 as par, {turn} as s from t0),
ids as (select p, max(case when par = 0 then conv_id end) as chosen_id, max(case when par = 1 then conv_id end) as rejected_id,
  least(coalesce(max(case when par = 0 then i end), 0), coalesce(max(case when par = 1 then i end), 0)) as l from t group by p),
diff as (select a.p, min(a.i) as d from t a join t b on a.p = b.p and a.i = b.i and a.par = 0 and b.par = 1 where a.role <> b.role or a.text <> b.text group by 1),
lcp as (select ids.p, least(l, coalesce(d - 1, l)) as k from ids left join diff using (p)),
prompt as (select t.p, string_agg(s, '' order by i) as c from t join lcp using (p) where par = 0 and i <= k group by 1),
{side("ch", 0)},{side("rj", 1)}
select ids.p as pair_id, chosen_id, rejected_id, cast(k as bigint) as prefix_turns, coalesce(prompt.c, '') as prompt,
  coalesce(ch.c, '') as chosen_completion, coalesce(rj.c, '') as rejected_completion, coalesce(ch.m, '') as chosen_spans, coalesce(rj.m, '') as rejected_spans,
  coalesce(ch.m, '') <> '' and coalesce(rj.m, '') <> '' as usable
from ids join lcp using (p) left join prompt using (p) left join ch using (p) left join rj using (p)
"""


QUERIES = {"op8_preference_format": op8_preference_format}
SQL = {"op8_preference_format": _sql()}
