"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target in words (weights 1, 2, 3, ... repeating over the sources in code-point order, capped at
``cap`` times the source's size, the excess reshared by weight). A document is taken floor(target/size) times
outright; the fraction that is left is its inclusion probability. The flight phase of the cube method moves these
probabilities along the null space of two constraints (document total, word total): any three undecided documents
span one such direction, and a random step along it decides at least one of them while both totals stay exact. It
runs in hash blocks of a source, then again over what the blocks left (at most two documents each), until what a source
has left fits one block; that one ends with a landing problem of at most twelve documents for each source (the two and the ten smallest, which the last flight
holds back), rounded to the nearest word total.

Edge cases: a null source is a source of its own, ordered last; null or blank texts have size 0 and are taken 0
words; null ids and repeated rows are rows like any others; an empty table gives no rows. Reruns agree: blocks and
draws depend on the seed and on the rows alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, pick, tagged, text_key, untagged

BLOCK_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
LANDING = 10  # the smallest documents of a source that the last flight leaves to the landing


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(stratum, source_size, target) of each source; ``sizes`` has a row (stratum, source, source_size) for each.

    Capping and resharing end at a common level L with target = least(cap * size, L * weight); L is found over the
    sources ordered by cap * size / weight. The windows cover the table of sources, not the documents.
    """
    ranked = sizes.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("level_at", F.col("most") / F.col("weight"))
    up = Window.orderBy("level_at", "turn")
    steps = ranked.withColumn("capped", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    steps = steps.withColumn("rest", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    steps = steps.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("capped")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("level_at"), F.struct("level_at", "turn", "level"))).over(Window.partitionBy())
    return steps.withColumn("common", level["level"]).select("stratum", "source_size", F.least("most", F.coalesce(F.col("common"), F.lit(0.0)) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, z: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Move probabilities ``p`` until at most two are fractional, keeping sum(p) and sum(p * z).

    ``land`` holds the smallest documents back and rounds them with those two to the nearest total of ``z``.
    """
    p, z = [x if EPS < x < 1 - EPS else float(round(x)) for x in p.tolist()], z.tolist()
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    held: list[int] = []
    if land:
        todo.sort(key=lambda i: z[i], reverse=True)
        todo, held = todo[:-LANDING], todo[-LANDING:]
    todo.reverse()
    draws = iter(rng.random(2 * len(todo) + 8).tolist())
    active: list[int] = []
    while True:
        while todo and len(active) < 3:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = active
            u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
            if not (u[0] or u[1] or u[2]):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and z[active[0]] == z[active[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = down = float("inf")
        for i, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0 < p[i] < 1]
    if land and (rest := active + held):
        bits = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
        off = bits - np.array([p[i] for i in rest])
        best = np.lexsort((np.abs(off.sum(1)), np.abs(off @ np.array([z[i] for i in rest]))))[0]
        for i, bit in zip(rest, bits[best].tolist()):
            p[i] = float(bit)
    return np.asarray(p)


def _level(rows: DataFrame, block_rows: int, seed: int, level: int) -> DataFrame:
    """One round of flights, a task for each block of each source; a source of one block lands."""
    columns = rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("size", "ascending")])
        draw = table.column("draw").to_numpy()
        rng = np.random.default_rng([seed, level, len(draw), int(draw[0]) & 0xFFFFFFFF])
        p = flight(table.column("p").to_numpy(), table.column("size").to_numpy().astype(float), rng, table.column("blocks")[0].as_py() == 1)
        return table.set_column(table.column_names.index("p"), "p", pa.array(p)).select(columns)

    blocks = cut(rows.groupBy("stratum").agg(F.ceil(F.count("*") / block_rows).alias("blocks")), f"mix-blocks{level}")
    # Other bits of the draw at every level, so that what one block leaves is spread.
    block = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks")).alias("block")
    return lookup(rows, blocks, ["stratum"], "inner").select(*columns, "blocks", block).groupBy("stratum", "block").applyInArrow(run, rows.schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 11, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, draw, size, source_size, target, copies) for every document; copies says how often the mix has it."""
    base = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = cut(
        base.select(
            "doc_id", "source", text_key("source").alias("stratum"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_draw("doc_id", "text", seed).alias("draw"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sized.groupBy("stratum", "source").agg(F.sum("size").alias("source_size")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = lookup(sized, targets, ["stratum"], "inner").withColumn("ratio", ratio)
    rows = rows.withColumn("whole", F.floor(F.col("ratio") + EPS).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    rows = rows.select("doc_id", "stratum", "draw", "size", "source_size", "target", "whole", "p")

    done, level = [], 0
    while not rows.isEmpty():
        flown = cut(_level(rows, block_rows, seed, level), f"mix-level{level}")
        done.append(flown.filter("p <= 0 or p >= 1"))
        rows = flown.filter("p > 0 and p < 1")
        level += 1
    if not done:
        return rows.select("doc_id", "draw", "size", "source_size", "target", F.col("whole").alias("copies"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "draw", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def row_draw(id_col: str, text_col: str, seed: int) -> F.Column:
    """A seeded 64-bit draw of a row, by its id and text."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def apply_mix(docs: DataFrame, copies: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 times: dropped).

    Repeated rows (same id and text) may differ in copies; each is matched by its turn among its equals.
    """
    rows, names = tagged(docs, key_id=id_col, key_text=text_col)
    rows = rows.withColumn("draw", row_draw("key_id", "key_text", seed))
    equals = Window.partitionBy("draw").orderBy(*[safe for safe, _ in names])
    rows = rows.withColumn("turn", F.row_number().over(equals))
    taken = copies.select("draw", "copies").withColumn("turn", F.row_number().over(Window.partitionBy("draw").orderBy("copies")))
    picked = rows.join(taken.filter("copies > 0"), ["draw", "turn"], "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return untagged(picked, names)
