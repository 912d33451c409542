"""Candidate reduction, chains, scores and combinations over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, reduce, score
from ..sources.facts import facts_long
from .tables import PART_TURNS_SQL, part_turns, table

FIELDS = ["p_brand", "p_type", "p_size"]


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = part_turns(spark, sf_dir)
    cube = reduce.pool_cube(table(spark, sf_dir, "part"), FIELDS)
    turns = reduce.with_candidates(turns, cube, FIELDS, ["p_brand"], "c_in")
    return reduce.with_candidates(turns, cube, FIELDS, FIELDS, "c_out")


def candidate_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counted(spark, sf_dir).withColumn("gain_bits", reduce.bits(F.col("c_in"), F.col("c_out")))
    rows = rows.withColumn("decision", reduce.decide(F.col("c_in"), F.col("c_out"), F.col("gain_bits")))
    total = score.total(score.base(F.col("decision")), score.uniqueness(F.col("c_out")), score.gain(F.col("gain_bits")), F.lit(1.0))
    return rows.withColumn("score", total).select("turn_id", "c_in", "c_out", F.round("gain_bits", 6).alias("gain_bits"), "decision", "score", score.level(F.col("score")).alias("level"))


CANDIDATE_REDUCTION = f"""
with {PART_TURNS_SQL},
b as (select p_brand, count(*) as n from part group by 1), bts as (select p_brand, p_type, p_size, count(*) as n from part group by 1, 2, 3),
r as (select turn_id, b.n as c_in, bts.n as c_out, greatest(0, log2(b.n / bts.n)) as bits
      from part_turns t join b using (p_brand) join bts on bts.p_brand = t.p_brand and bts.p_type = t.p_type and bts.p_size = t.p_size),
d as (select *, case when c_out <= 1 and c_in - c_out >= 1 and bits >= 0.5 then 'indirect_asset_restoration' else 'none' end as decision from r),
s as (select *, case when decision <> 'none' then round(least(100, 50 + 25 * 1.0 + 15 * least(1, bits / 3) + 10), 2) end as score from d)
select turn_id, c_in, c_out, round(bits, 6) as gain_bits, decision, score,
  case when score >= 85 then 'CRITICAL' when score >= 70 then 'HIGH' when score >= 45 then 'MEDIUM' when score is not null then 'LOW' end as level from s
"""


def contributing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = part_turns(spark, sf_dir).select("turn_id", "p_brand", "p_type", F.col("other_size").alias("p_size"))
    cube = reduce.pool_cube(table(spark, sf_dir, "part"), FIELDS)
    for used, name in ((["p_brand"], "b"), (["p_brand", "p_type"], "bt"), (["p_brand", "p_size"], "bs"), (FIELDS, "bts")):
        turns = reduce.with_candidates(turns, cube, FIELDS, used, name)
    turns = turns.withColumn("by_type", (F.col("bt") > 0) & (F.col("bt") < F.col("b")))
    left, after = F.when(F.col("by_type"), F.col("bt")).otherwise(F.col("b")), F.when(F.col("by_type"), F.col("bts")).otherwise(F.col("bs"))
    by_size = F.col("p_size").isNotNull() & (after > 0) & (after < left)
    return turns.select("turn_id", "by_type", by_size.alias("by_size"), F.when(by_size, after).otherwise(left).alias("remaining"))


CONTRIBUTING_ANCHORS = f"""
with {PART_TURNS_SQL},
c as (select turn_id, other_size, (select count(*) from part x where x.p_brand = t.p_brand) as b,
  (select count(*) from part x where x.p_brand = t.p_brand and x.p_type = t.p_type) as bt,
  (select count(*) from part x where x.p_brand = t.p_brand and x.p_size = t.other_size) as bs,
  (select count(*) from part x where x.p_brand = t.p_brand and x.p_type = t.p_type and x.p_size = t.other_size) as bts from part_turns t),
d as (select *, bt > 0 and bt < b as by_type from c),
e as (select *, case when by_type then bt else b end as l, case when by_type then bts else bs end as a from d),
f as (select *, other_size is not null and a > 0 and a < l as by_size from e)
select turn_id, by_type, by_size, case when by_size then a else l end as remaining from f
"""


def reduction_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = part_turns(spark, sf_dir).select("turn_id", "p_brand", "p_type", F.col("other_size").alias("p_size"))
    pool = table(spark, sf_dir, "part")
    cube, total = reduce.pool_cube(pool, FIELDS), pool.count()
    for i in range(3):
        turns = reduce.with_candidates(turns, cube, FIELDS, FIELDS[: i + 1], f"n{i + 1}")
    counts = F.array(F.lit(total), "n1", "n2", "n3")
    steps = F.transform(F.array(*map(F.lit, FIELDS)), lambda f, i: F.struct((i + 1).alias("step"), f.alias("field_name"), F.get(counts, i).alias("before"), F.get(counts, i + 1).alias("after")))
    # The chain stops with the step that empties the pool.
    stated = F.array(F.lit(True), F.lit(True), F.col("p_size").isNotNull())
    return turns.select("turn_id", F.explode(F.filter(steps, lambda s: (s["before"] > 0) & F.get(stated, s["step"] - 1))).alias("s")).select("turn_id", F.col("s.step").cast("int").alias("step"), "s.field_name", "s.before", "s.after")


REDUCTION_CHAIN = f"""
with {PART_TURNS_SQL},
c as (select turn_id, (select count(*) from part) as n0, (select count(*) from part x where x.p_brand = t.p_brand) as n1,
  (select count(*) from part x where x.p_brand = t.p_brand and x.p_type = t.p_type) as n2,
  (select count(*) from part x where x.p_brand = t.p_brand and x.p_type = t.p_type and x.p_size = t.other_size) as n3, other_size from part_turns t)
select turn_id, 1 as step, 'p_brand' as field_name, n0 as before, n1 as after from c
union all select turn_id, 2, 'p_type', n1, n2 from c where n1 > 0 union all select turn_id, 3, 'p_size', n2, n3 from c where n2 > 0 and other_size is not null
"""


def protected_value_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    before = reduce.entropy(pool, ["p_brand"], "p_size").withColumnsRenamed({"distinct_values": "before_values", "entropy": "before_entropy"})
    after = reduce.entropy(pool, ["p_brand", "p_type"], "p_size").withColumnsRenamed({"distinct_values": "after_values", "entropy": "after_entropy"})
    drop = F.col("before_entropy") - F.col("after_entropy")
    restored = (F.col("before_values") > 1) & (F.col("after_values") <= 1) & (drop >= 0.5)
    return after.join(before, "p_brand").select("p_brand", "p_type", "before_values", "after_values", F.round(drop, 6).alias("entropy_drop"), restored.alias("restored"))


PROTECTED_VALUE_CONVERGENCE = """
with b as (select p_brand, p_size, count(*) as n from part group by 1, 2), bt as (select p_brand, p_type, p_size, count(*) as n from part group by 1, 2, 3),
eb as (select p_brand, count(*) as v, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from b group by 1),
et as (select p_brand, p_type, count(*) as v, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from bt group by 1, 2)
select et.p_brand, p_type, eb.v as before_values, et.v as after_values, round(eb.h - et.h, 6) as entropy_drop, eb.v > 1 and et.v <= 1 and eb.h - et.h >= 0.5 as restored
from et join eb on et.p_brand = eb.p_brand
"""


def k_anonymity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    ks = F.explode(F.array(*[F.lit(k) for k in (1, 2, 5, 10, 50)])).alias("k")
    return sizes.select("n", ks).filter("n <= k").groupBy("k").agg(F.count("*").alias("groups_at_risk"), F.sum("n").alias("rows_at_risk"))


K_ANONYMITY = """
with g as (select count(*) as n from customer group by c_nationkey, c_mktsegment)
select k, count(*) as groups_at_risk, cast(sum(n) as bigint) as rows_at_risk from g, (values (1), (2), (5), (10), (50)) v(k) where n <= k group by k
"""


def _order_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("turn_id"), F.col("l_partkey").alias("p_partkey"))
    stated = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("canonical")) for f in ("p_brand", "p_type")])).alias("a")
    return stated.select("turn_id", fields).select("turn_id", "a.*").distinct()


def claim_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _order_anchors(spark, sf_dir)
    return anchors.select("turn_id").distinct().join(claims.conflicts(anchors, "turn_id"), "turn_id", "left").fillna(0, ["fields_in_conflict"])


CLAIM_CONFLICT = """
with a as (select l_orderkey as turn_id, count(distinct p_brand) as b, count(distinct p_type) as t from lineitem join part on p_partkey = l_partkey group by 1)
select turn_id, cast((b >= 2)::int + (t >= 2)::int as bigint) as fields_in_conflict from a
"""


def claim_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 over supplier claims: the nation and the balance band of each order's customer, bound to customers."""
    pool = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    facts = facts_long(pool, "c_custkey", ["c_mktsegment", "c_nationkey"])
    suppliers = table(spark, sf_dir, "supplier")
    fields = F.explode(F.array(
        F.struct(F.lit("c_nationkey").alias("field_name"), F.col("s_nationkey").cast("string").alias("canonical")),
        F.struct(F.lit("c_mktsegment").alias("field_name"), F.lit("BUILDING").alias("canonical")),
        F.struct(F.lit("c_mktsegment").alias("field_name"), F.lit("MACHINERY").alias("canonical")),
    )).alias("a")
    return claims.bind(suppliers.select("s_suppkey", fields).select("s_suppkey", "a.*"), facts, "s_suppkey")


CLAIM_BINDING = """
select s_suppkey, (select count(*) from customer where c_nationkey = s_nationkey and c_mktsegment in ('BUILDING', 'MACHINERY')) as candidates from supplier
"""

RULES = [("Brand#1", "tier", "standard"), ("Brand#2", "tier", "standard"), ("Brand#3", "tier", "premium"), ("Brand#3", "tier", "premium"), ("Brand#4", "segment", "industrial")]


def rule_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.match import infer

    rules = spark.createDataFrame([(i, "brand_group", v, f, t) for i, (v, f, t) in enumerate(RULES)], "ord int, src_field string, src_value string, tgt_field string, tgt_value string")
    anchors = part_turns(spark, sf_dir).select("turn_id", F.lit("brand_group").alias("field_name"), F.substring("p_brand", 1, 7).alias("canonical"))
    return infer(anchors, F.broadcast(rules)).select("turn_id", "field_name", "canonical")


RULE_INFERENCE = f"""
with {PART_TURNS_SQL}, r(v, f, t) as (select distinct * from (values {", ".join(map(str, RULES))}))
select turn_id, f as field_name, t as canonical from part_turns join r on v = substr(p_brand, 1, 7)
"""


def minimal_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor subsets (bit 1 brand, 2 type, 4 size) that single out one part, without smaller ones inside."""
    pool = table(spark, sf_dir, "part").select("p_partkey", *FIELDS)
    cube = reduce.pool_cube(pool, FIELDS)
    rows = pool
    for mask in range(1, 8):
        rows = reduce.with_candidates(rows, cube, FIELDS, [f for i, f in enumerate(FIELDS) if mask >> i & 1], f"m{mask}")
    long = rows.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), (F.col(f"m{m}") == 1).alias("hit")) for m in range(1, 8)])).alias("x")).select("p_partkey", "x.*")
    return reduce.minimal_combinations(long, ["p_partkey"]).select("p_partkey", F.col("m").alias("mask"))


MINIMAL_COMBOS = """
with c as (select p_partkey, count(*) over (partition by p_brand) = 1 as m1, count(*) over (partition by p_type) = 1 as m2, count(*) over (partition by p_brand, p_type) = 1 as m3,
  count(*) over (partition by p_size) = 1 as m4, count(*) over (partition by p_brand, p_size) = 1 as m5, count(*) over (partition by p_type, p_size) = 1 as m6,
  count(*) over (partition by p_brand, p_type, p_size) = 1 as m7 from part),
h as (select p_partkey, 1 as mask from c where m1 union all select p_partkey, 2 from c where m2 union all select p_partkey, 3 from c where m3 union all select p_partkey, 4 from c where m4
  union all select p_partkey, 5 from c where m5 union all select p_partkey, 6 from c where m6 union all select p_partkey, 7 from c where m7)
select p_partkey, mask from h where not exists (select 1 from h s where s.p_partkey = h.p_partkey and s.mask <> h.mask and (s.mask & h.mask) = s.mask)
"""

QUERIES = {f.__name__: f for f in (candidate_reduction, contributing_anchors, reduction_chain, protected_value_convergence, k_anonymity_groups, claim_conflict, claim_binding, rule_inference, minimal_combos)}
SQL = {
    "candidate_reduction": CANDIDATE_REDUCTION, "contributing_anchors": CONTRIBUTING_ANCHORS, "reduction_chain": REDUCTION_CHAIN, "protected_value_convergence": PROTECTED_VALUE_CONVERGENCE,
    "k_anonymity_groups": K_ANONYMITY, "claim_conflict": CLAIM_CONFLICT, "claim_binding": CLAIM_BINDING, "rule_inference": RULE_INFERENCE, "minimal_combos": MINIMAL_COMBOS,
}
