"""From analysed turns to responses: routing, gate, public form, evidence and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analyze, kb, render, route, score


def answers(turns: DataFrame, results: DataFrame, safe: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Turns with their findings' count, score, risk level and the answer to give with its label.

    ``results``: findings; ``safe``: (turn_id, safe_answer); ``second``: (turn_id, checked, left, second_answer) of a second rewrite.
    """
    rows = turns.join(score.rollup(results, ["turn_id"]), "turn_id", "left").join(safe.select("turn_id", "safe_answer"), "turn_id", "left")
    if second is None:
        rows = rows.withColumns({"checked": F.lit(False), "left": F.lit(False), "second_answer": F.lit(None).cast("string")})
    else:
        rows = rows.join(second, "turn_id", "left")
    picked = render.select_answer(F.col("checked"), F.col("left"), F.col("findings") > 0, F.coalesce("safe_answer", F.lit("")), F.col("second_answer"))
    rows = rows.withColumn("_x", picked).withColumns({"answer": F.col("_x.answer"), "safe_answer_used": F.col("_x.label")})
    return rows.withColumns({"findings": F.coalesce("findings", F.lit(0)), "score": F.coalesce("score", F.lit(0.0)), "risk_level": F.coalesce("risk_level", F.lit("NONE"))}).drop("_x", "checked", "left", "second_answer", "safe_answer")


def gated(rows: DataFrame, scene: str = "sub_scene", subject: str = "subject", slot: str = "slot_question") -> DataFrame:
    """Confidential answers at risk become safe ones: the slot answer where a slot was asked for, else the sub-scene's template."""
    safe = F.coalesce(F.when(F.col(slot), render.slot_answer(F.col(subject))), render.safe_template(F.col(scene)))
    return rows.withColumns({"answer": F.when(F.col("risk"), safe).otherwise(F.col("answer")), "safe_answer_used": F.when(F.col("risk"), "cfa_safe_answer").otherwise(F.col("safe_answer_used"))})


def public(rows: DataFrame, sensitive: str = "sensitive_response") -> DataFrame:
    """(turn_id, response): the JSON that leaves the engine; raw answers and findings only of responses that aren't sensitive."""
    shown = ["answer", "risk_level", "score", "safe_answer_used", "findings", "intent", "routed_scenario", "answer_strategy"]
    open_ = F.coalesce(F.col(sensitive), F.lit(True))
    hidden = [F.when(~open_, F.col(c)).alias(c) for c in ("raw_answer", "findings_summary") if c in rows.columns]
    body = F.struct((F.col("findings") > 0).alias("risk_detected"), *[F.col(c) for c in shown if c in rows.columns], *hidden)
    return rows.select("turn_id", F.to_json(body).alias("response"))


def strategy(turns: DataFrame, requested: str = "scenario", text: str = "user_input", key: str = "turn_id") -> DataFrame:
    """Adds intent, confidence, routed_scenario and answer_strategy: a named scenario stays, ``auto`` and ``general`` go where the
    intent says; outside the scenarios the general strategies hold."""
    routed = route.intents(turns, key, text).select(key, F.col("domain").alias("intent"), "confidence")
    rows = turns.join(routed, key)
    free = F.coalesce(F.col(requested), F.lit("auto")).isin("auto", "general")
    scene = F.when(free, route.scenario(F.col("intent"))).otherwise(F.col(requested))
    return rows.withColumn("routed_scenario", scene).withColumn("answer_strategy", F.when(F.col("routed_scenario") == "general", route.general_answer(F.col("intent"), F.col(text))["strategy"]).otherwise("cfa_gated"))


def chat(turns: DataFrame, selection: DataFrame, fallback: DataFrame, local: DataFrame) -> DataFrame:
    """How each confidential turn got its units: (turn_id, selection_source, use).

    ``selection``: (turn_id, raw) a generator's answer; ``fallback``: (turn_id, units) units picked deterministically;
    ``local``: (turn_id, matched). A generator that wants no units, chooses none or can't be read gives way to the
    fallback; the first two only where the local match holds. ``use`` is selection, fallback or none.
    """
    from ..functions.llm_json import selection as parsed

    rows = turns.select("turn_id").join(selection, "turn_id", "left").join(fallback, "turn_id", "left").join(local.select("turn_id", "matched"), "turn_id", "left")
    rows = rows.withColumn("_s", parsed(F.col("raw")))
    chosen = F.aggregate(F.coalesce(F.col("_s.content_units_to_load"), F.array().cast("array<struct<kb_id:string,unit_ids:array<string>>>")), F.lit(0), lambda n, r: n + F.size(F.coalesce(r["unit_ids"], F.array().cast("array<string>"))))
    able = (F.coalesce("units", F.lit(0)) > 0) & F.coalesce("matched", F.lit(False))
    broken, unwanted = F.col("_s").isNull(), F.coalesce(F.col("_s.needs_internal_kb") == F.lit(False), F.lit(False))
    source = F.when(F.col("raw").isNull(), "selection_failed").when(broken & (F.coalesce("units", F.lit(0)) > 0), "deterministic_fallback").when(broken, "parse_failed_empty_selection")
    source = source.when(unwanted & able, "deterministic_fallback_no_internal_kb").when(unwanted, "no_internal_kb").when((chosen == 0) & able, "deterministic_fallback_empty_selection").when(chosen == 0, "empty_selection").otherwise("llm_selection")
    out = rows.select("turn_id", source.alias("selection_source"))
    return out.withColumn("use", F.when(F.col("selection_source") == "llm_selection", "selection").when(F.col("selection_source").startswith("deterministic"), "fallback").otherwise("none"))


def evidence(found: DataFrame, pool_long: DataFrame, policy: analyze.Policy) -> DataFrame:
    """Findings with the restored fields as (name, label, value), the restored fact as text and the lines of reasoning.

    ``found`` has turn_id, place, target_id, target_name, finding_type, restored_fields, candidates, gain_bits and key_summary.
    """
    label = F.col("name")
    for name, text in policy.labels.items():
        label = F.when(F.col("name") == name, text).otherwise(label)
    named = found.select("turn_id", "place", "target_id", F.posexplode("restored_fields").alias("n", "name"))
    values = pool_long.select(F.col("fact_id").alias("target_id"), F.col("field_name").alias("name"), "value")
    told = named.join(values, ["target_id", "name"], "left").withColumn("label", label).groupBy("turn_id", "place").agg(F.array_sort(F.collect_list(F.struct("n", "name", "label", F.coalesce("value", F.lit("")).alias("value")))).alias("fields"))
    rows = found.join(told, ["turn_id", "place"], "left").withColumn("fields", F.transform(F.coalesce("fields", F.array().cast("array<struct<n:int,name:string,label:string,value:string>>")), lambda f: F.struct(f["name"].alias("name"), f["label"].alias("label"), f["value"].alias("value"))))
    rows = rows.withColumn("restored_fact", F.when(F.col("target_id").isNull(), "受控字段状态被还原").otherwise(render.restored_fact(F.col("target_name"), F.col("fields"))))
    lines = render.reasoning(F.col("finding_type"), F.col("key_summary"), F.col("restored_fact"), F.col("input_candidates"), F.col("final_candidates"), F.col("gain_bits"))
    return rows.withColumn("reasoning", lines)


def audit(turns: DataFrame, found: DataFrame, leaks: DataFrame) -> DataFrame:
    """Audit rows of turns (turn_id, user_input, model_output, safe_answer_used): hashes instead of texts, what was triggered and
    restored, the least candidate counts and the greatest gain."""
    own = found.groupBy("turn_id").agg(
        F.array_sort(F.collect_set("finding_type")).alias("trigger_types"), F.array_sort(F.collect_set(F.col("target_id").cast("string"))).alias("restored_fact_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("restored_fields")))).alias("restored_fields"), F.min("input_candidates").alias("input_candidate_count"),
        F.min("final_candidates").alias("final_candidate_count"), F.round(F.max("gain_bits"), 4).alias("information_gain_bits"),
    )
    rows = turns.join(own, "turn_id", "left").join(leaks.groupBy("turn_id").agg(F.count("*").alias("direct_hit_count")), "turn_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "turn_id", F.sha2(F.coalesce("user_input", F.lit("")), 256).alias("user_input_hash"), F.sha2(F.coalesce("model_output", F.lit("")), 256).alias("llm_output_hash"),
        (F.col("trigger_types").isNotNull() | F.col("direct_hit_count").isNotNull()).alias("risk_detected"), *[F.coalesce(c, none).alias(c) for c in ("trigger_types", "restored_fact_ids", "restored_fields")],
        F.coalesce("direct_hit_count", F.lit(0)).alias("direct_hit_count"), F.coalesce("input_candidate_count", F.lit(0)).alias("input_candidate_count"),
        F.coalesce("final_candidate_count", F.lit(0)).alias("final_candidate_count"), F.coalesce("information_gain_bits", F.lit(0.0)).alias("information_gain_bits"), "safe_answer_used",
    )


def sanitized_knowledge(records: DataFrame, decisions: DataFrame, total: int) -> DataFrame:
    """(turn_id, knowledge): what a prompt may be told of confidential records: their number by sub-scene, whether the question
    is related to some, and how many of them, in buckets."""
    own = kb.coverage(records)
    told = own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub_scene", "records")))).alias("coverage"))
    query = F.struct(F.col("matched").alias("related"), F.col("sub_scene").alias("safe_topic"), kb.count_bucket(F.col("match_count")).alias("matched_count_bucket"))
    body = F.struct(F.lit("sanitized_confidential_summary").alias("kb_type"), F.lit(1).alias("version"), F.lit(total).alias("total_records"), "coverage", query.alias("current_query"))
    return decisions.crossJoin(F.broadcast(told)).select("turn_id", F.to_json(body).alias("knowledge"))  # one row on that side


def secondary(rewritten: Column, risky: Column) -> Column:
    """(checked, left, second_answer) of a second rewrite: one that is empty or found risky again leaves the fallback."""
    from .redact import second_rewrite

    return F.struct(F.lit(True).alias("checked"), F.coalesce(risky, F.lit(True)).alias("left"), second_rewrite(rewritten, risky).alias("second_answer"))
