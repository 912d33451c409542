"""Generators: the one point where Python callables join a plan. Without one, canned answers stand in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import safe_name
from ..operators.detect import blocked_prompts, has_markers

RULES_ONLY, WITH_GENERATOR = "rule_only", "rule_plus_llm"


def effective_mode(requested: str, scenario: str, able: bool) -> tuple[str, str]:
    """The mode that runs and why: confidential scenarios and those without a generator go by rules alone."""
    if requested == WITH_GENERATOR and scenario == "confidential":
        return RULES_ONLY, "confidential"
    if requested == WITH_GENERATOR and not able:
        return RULES_ONLY, "no_generator"
    return requested, ""


def generate(prompts: DataFrame, call: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """Adds ``answer`` and ``blocked`` (markers found).

    A prompt with a marker is never sent and has a null answer, as have failed calls. ``call`` gets the prompts of an
    Arrow batch as a list; it is sent to the executors, so it opens its own connections.
    """
    rows = blocked_prompts(prompts, prompt)
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())])

    def run(batches):
        for batch in batches:
            texts, marks = batch.column(prompt).to_pylist(), batch.column("blocked").to_pylist()
            send = [i for i, (t, m) in enumerate(zip(texts, marks)) if t is not None and not m]
            out: list = [None] * len(texts)
            try:
                for i, answer in zip(send, call([texts[i] for i in send]) if send else []):
                    out[i] = answer
            except Exception:  # a generator that fails leaves the rules to answer
                pass
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def canned(prompts: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """The same from a table of answers (key.., answer): for tests and replays."""
    rows = blocked_prompts(prompts, "prompt").join(answers.select(*key, F.col("answer").alias("_a")), key, "left")
    return rows.withColumn("answer", F.when(F.size("blocked") == 0, F.col("_a"))).drop("_a")


def requests(prompts: DataFrame, model: str, key: str = "request_id", purpose: str = "purpose", max_tokens: int = 512, temperature: float = 0.2) -> DataFrame:
    """Debug payloads of the calls that are made: call_id, file name and the request body; no credentials are in it."""
    order = Window.partitionBy(key).orderBy("seq")
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")))
    rows = prompts.withColumn("_n", F.row_number().over(order))
    number = F.format_string("%03d", "_n")
    return rows.select(key, purpose, "seq", F.concat_ws("_", F.col(key).cast("string"), purpose, number).alias("call_id"), F.concat(safe_name(F.col(purpose)), F.lit("_"), number, F.lit(".json")).alias("file"), body.alias("payload"))


def last_payload(payloads: DataFrame, key: str = "request_id", purpose: str = "purpose") -> DataFrame:
    """The newest payload of each request and purpose, with status 200; one that holds a marker has status 403 and no payload."""
    newest = Window.partitionBy(key, purpose).orderBy(F.desc("seq"), F.desc("call_id"))
    rows = payloads.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    held = has_markers(F.col("payload"))
    return rows.withColumn("status", F.when(held, 403).otherwise(200)).withColumn("payload", F.when(~held, F.col("payload")))


def read_env(text: str, known: dict[str, str]) -> dict[str, str]:
    """Settings of a .env text added to the known ones, which are never changed; comments, blank and malformed lines are skipped."""
    out = dict(known)
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name.strip() and not name.lstrip().startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("'\""))
    return out
