"""Proportional stratified interleaving: shards that all match the source mixture, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n gets the fractional rank (2r-1)/2n; all
rows are ordered by it and cut into shards of equal row counts (at most one apart).

No window ever covers a whole source or the whole table: ranks come from hash buckets of about ``bucket_rows`` rows
and the counts of the buckets before them; the final positions come from fractional-rank buckets, whose offsets
follow from the source counts alone. Texts are never shuffled, only ids, sizes and checksums.

Edge cases: a null source is a source of its own; a null text counts as empty (size 8); null or repeated ids and
repeated rows are placed row by row (rows equal in all columns are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, pick, text_key

BUCKET_ROWS = 50_000
LEAST_BUCKETS, LEAST_ROWS = 512, 200  # small tables: more, smaller buckets, so that all cores work
HASH_BITS = 60


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): size is UTF-8 bytes plus 8, slots are gapless from 0 in each shard."""
    base = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = base.select("doc_id", text_key("source").alias("stratum"), F.conv(F.substring(draw, 1, HASH_BITS // 4), 16, 10).cast("long").alias("draw"), "text")
    total = keyed.count()
    buckets = max(1, -(-total // bucket_rows), min(LEAST_BUCKETS, total // LEAST_ROWS))
    part = F.expr(f"((draw >> {HASH_BITS - 30}) * {buckets}L) >> 30")

    # Counts by (source, hash bucket): a row for each, not for each document.
    counts = keyed.select("stratum", part.alias("part")).groupBy("stratum", "part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("stratum").orderBy("part")
    offsets = counts.select("stratum", "part", (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("n_stratum"))

    slim = keyed.select("doc_id", "stratum", part.alias("part"), "draw", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranked = (
        lookup(slim, offsets, ["stratum", "part"], "inner")
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "part").orderBy("draw", "doc_id", "text_crc32", "size")))
        .withColumn("place", F.expr(f"((2 * rank - 1) * {buckets}L) div (2 * n_stratum)"))
        .withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("n_stratum")))
        .select("doc_id", "stratum", "size", "text_crc32", "rank", "place", "fraction")
    )
    # Rows before place g, summed over sources: ranks r with (2r-1) * buckets < 2 * n * g, at most n.
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    starts = (
        sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("g"))
        .groupBy(F.col("g").cast("long").alias("place"))
        .agg(F.sum(F.expr(f"least(n, (2 * n * g + {buckets}L + {2 * buckets}L - 1) div {2 * buckets}L - 1)")).alias("ahead"))
    )
    order = Window.partitionBy("place").orderBy("fraction", "stratum", "rank")
    placed = lookup(ranked, starts, ["place"], "inner").withColumn("position", F.col("ahead") + F.row_number().over(order) - 1)
    shard = F.expr(f"(position * {shards}L) div {max(total, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot")
    )
