"""Candidate reduction: how far the anchors of a turn narrow the fact pool.

Turns hold one column for each anchored field (null: no anchor). Candidate counts come from a cube of the facts over
those fields, joined on the values and the set of fields that a turn anchors, so no turn ever meets a fact.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def pool_cube(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(gid, fields.., candidates): how many facts have each combination of values of each set of fields."""
    return facts.cube(*fields).agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("candidates"))


def with_candidates(turns: DataFrame, cube: DataFrame, fields: list[str], used: list[str], out: str, when: Column | None = None) -> DataFrame:
    """Adds ``out``: the number of facts that have a turn's values of the ``used`` fields (of ``fields`` of the cube)."""
    bits = {f: 1 << (len(fields) - 1 - i) for i, f in enumerate(fields)}
    # grouping_id has a bit for every field that is aggregated away.
    gid = fold(lambda a, b: a + b, [F.when(F.col(f).isNull(), bits[f]).otherwise(0) if f in used else F.lit(bits[f]) for f in fields])
    side = cube.select(F.col("gid").alias("_gid"), *[F.col(f).alias(f"_{f}") for f in fields], F.col("candidates").alias(out))
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    match = [F.col("_gid") == gid] + [F.col(f"_{f}").eqNullSafe(F.col(f)) if f in used else F.col(f"_{f}").isNull() for f in fields]
    return turns.join(side, match, "left").drop("_gid", *[f"_{f}" for f in fields]).withColumn(out, F.coalesce(out, F.lit(0)))


def bits(c_in: Column, c_out: Column) -> Column:
    return F.when((c_in > 0) & (c_out > 0), F.greatest(F.lit(0.0), F.log2(c_in / c_out))).otherwise(F.lit(0.0))


def entropy(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group.., distinct_values, entropy) of non-empty values."""
    counts = rows.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(*group, value).agg(F.count("*").alias("n"))
    n, nlogn = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return counts.groupBy(*group).agg(F.count("*").alias("distinct_values"), (F.log2(n) - nlogn / n).alias("entropy"))


def decide(c_in: Column, c_out: Column, gain: Column, k: int = 1, min_reduction: int = 1, min_bits: float = 0.5, restored: Column | None = None) -> Column:
    """The restoration decision, in order: conflict, indirect asset, protected value, none."""
    out = F.when(c_out == 0, "conflict").when((c_out <= k) & (c_in - c_out >= min_reduction) & (gain >= min_bits), "indirect_asset_restoration")
    return (out.when(restored, "indirect_protected_value_restoration") if restored is not None else out).otherwise("none")


def contributing(candidates: Column, anchor_ids: Column) -> Column:
    """Greedy fold over ordered anchors, each an array of fact ids: positions of those that narrow without emptying.

    ``candidates`` is the array of fact ids before; for pools small enough to list ids (use the cube otherwise).
    """
    kind = "struct<left:array<bigint>,hit:array<int>>"

    def step(acc, x):
        after = F.array_intersect(acc["left"], x["ids"])
        narrows = (F.size(after) > 0) & (F.size(after) < F.size(acc["left"]))
        return F.when(narrows, F.struct(after.alias("left"), F.concat(acc["hit"], F.array(x["pos"])).alias("hit")).cast(kind)).otherwise(acc)

    numbered = F.transform(anchor_ids, lambda ids, i: F.struct(ids.alias("ids"), i.alias("pos")))
    return F.aggregate(numbered, F.struct(candidates.alias("left"), F.array().cast("array<int>").alias("hit")).cast(kind), step, lambda acc: acc["hit"])


def minimal_combinations(counts: DataFrame, key: list[str], mask: str = "mask", hit: str = "hit") -> DataFrame:
    """Of the anchor subsets (bit masks) that restore, those without a smaller restoring subset."""
    hits = counts.filter(F.col(hit)).select(*key, F.col(mask).alias("m"))
    small = hits.select(*key, F.col("m").alias("sub"))
    inside = [hits[k] == small[k] for k in key] + [hits["m"].bitwiseAND(small["sub"]) == small["sub"], hits["m"] != small["sub"]]
    return hits.join(small, inside, "left_anti")
