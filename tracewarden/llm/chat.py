"""Preference formatting of chosen and rejected conversations, in DataFrame operations.

The longest common prefix of turns (same role and text) is rendered once as the prompt; the turns after it become two
completions, each with the character spans that are trained on: the text and end mark of assistant turns. All other
characters are masked.

Edge cases: turns are ordered by number, then role and text (null first), so repeated rows stay; null roles and texts
render as empty and equal each other; a pair that lacks a side gets an empty conversation there; equal conversations
give empty completions (``usable`` is false: no trained character on one side); rows with a null conversation id form
one conversation without a pair id, kept as a chosen side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

START, END = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row for each conversation, its turns in order as array of (role, text)."""
    base = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = base.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    clean = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return rows.select("conv_id", clean.alias("turns"))


def render(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def trained_spans(turns: F.Column, role: str = "assistant") -> F.Column:
    """Array of (start, end) character spans of the rendered turns that are not masked."""
    head = lambda t: F.length(t["role"]) + len(START) + 1
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc, t):
        start = acc["at"] + head(t)
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(kind)

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind), step, lambda acc: acc["spans"])


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` has pair_id, chosen and rejected (arrays of turns); adds the prompt, completions and their spans."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.withColumn("c", F.coalesce("chosen", none)).withColumn("r", F.coalesce("rejected", none))
    least = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.transform(F.zip_with("c", "r", lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False))), False)
    rows = rows.withColumn("prefix_turns", F.when(differ > 0, F.least(differ.cast("int") - 1, least)).otherwise(least))
    tail = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumn("prompt", render(F.slice("c", 1, F.col("prefix_turns"))))
    for side, col in (("chosen", "c"), ("rejected", "r")):
        rows = rows.withColumn(f"{side}_completion", render(tail(col))).withColumn(f"{side}_spans", trained_spans(tail(col)))
    usable = (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0)
    return rows.drop("c", "r", "chosen", "rejected").withColumn("usable", usable)
