"""Policies, public rules and semantic aliases: small JSON files, read on the driver."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import Policy
from ..operators.detect import Terms


def read_json(spark: SparkSession, path: str):
    """The JSON of a file at any path that Spark reads; a byte-order mark is ignored."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("﻿"))


def read_policy(spark: SparkSession, path: str) -> tuple[Policy, Terms, dict]:
    """A policy object: what the analysis needs, the detectors' terms, and the object itself. Anything but an object is an error."""
    data = read_json(spark, path)
    if not isinstance(data, dict):
        raise ValueError("a policy must be a JSON object")
    return policy_of(data), terms_of(data), data


def policy_of(data: dict) -> Policy:
    names = lambda key: list(data.get(key) or [])
    return Policy(
        names("field_order"), names("protected_fields"), names("identifier_fields"), names("quasi_identifier_fields"), names("sensitive_fields"), dict(data.get("field_labels") or {}), str(data.get("display_field", "system_name")),
        int(data.get("uniqueness_k", 1)), int(data.get("protected_value_k", 1)), int(data.get("min_candidate_reduction", 1)), float(data.get("min_information_gain_bits", 0.5)), float(data.get("min_protected_entropy_drop_bits", 0.5)),
        bool(data.get("indirect_restoration_enabled", True)), {k: float(v) for k, v in (data.get("match_type_weights") or {}).items()}, dict(data.get("safe_replacements") or {}), str(data.get("safe_hint", "")),
    )


def terms_of(data: dict) -> Terms:
    names = lambda key: list(data.get(key) or [])
    return Terms(
        bool(data.get("confirmation_detection_enabled", False)), bool(data.get("slot_detection_enabled", False)), names("confirmation_terms"), names("refusal_terms"), names("common_text_fragments"),
        names("slot_query_terms"), names("slot_attribute_terms"), names("slot_connector_terms"), str(data.get("slot_output_value_pattern", "")), dict(data.get("slot_value_unit_hints") or {}),
    )


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Public rules: a list, or an object with ``rules`` (else ``public_rules``); what is no object is left out."""
    data = read_json(spark, path)
    if isinstance(data, dict):
        data = data.get("rules", data.get("public_rules", []))
    if not isinstance(data, list):
        raise ValueError("public rules must be a list, or an object that holds one")
    return [r for r in data if isinstance(r, dict)]


def merge_rules(own: list[dict], more: list[dict]) -> list[dict]:
    """The policy's rules, then the others; repeated ones stay."""
    return [*own, *more]


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """(rule, src_field, src_value, tgt_field, tgt_value, ord): a row for each value and implication, in order."""
    rows = [(r.get("name", "public-rule"), r.get("field"), str(v), k, str(t), i) for i, r in enumerate(rules) for v in r.get("values", []) for k, t in (r.get("implies") or {}).items()]
    return spark.createDataFrame(rows, "rule string, src_field string, src_value string, tgt_field string, tgt_value string, ord int")


def read_semantic(spark: SparkSession, path: str) -> DataFrame:
    """(field_name, canonical, kind, term, ord) of semantic aliases; a wrapping ``semantic_aliases`` key is taken off, and what
    is no object is left out."""
    data = read_json(spark, path)
    if not isinstance(data, dict):
        raise ValueError("semantic aliases must be a JSON object")
    data = data.get("semantic_aliases", data)
    rows = [
        (name, str(canonical), kind, str(term), i)
        for name, values in data.items() if isinstance(values, dict)
        for canonical, info in values.items() if isinstance(info, dict)
        for kind, key in (("alias", "aliases"), ("component", "components"), ("clue", "partial_clues"))
        for i, term in enumerate(info.get(key) or [])
    ]
    return spark.createDataFrame(rows, "field_name string, canonical string, kind string, term string, ord int")


def aliases_table(spark: SparkSession, data: dict) -> DataFrame:
    """(field_name, canonical, term) of a policy's ``field_aliases``."""
    rows = [(f, c, t) for f, values in (data.get("field_aliases") or {}).items() for c, terms in values.items() for t in terms]
    return spark.createDataFrame(rows, "field_name string, canonical string, term string")


def field_schema(policy: Policy, extra: list[str] = ()) -> list[dict]:
    """(name, label, protected, identifier, required) of the id, the policy's fields and further ones, in order."""
    names = list(dict.fromkeys(["id", *policy.order, *extra]))
    return [{"name": n, "label": policy.labels.get(n, n), "protected": n in policy.protected, "identifier": n in policy.identifiers, "required": n == "id"} for n in names if n]


def with_labels(policy: Policy, labels: dict[str, str]) -> Policy:
    return replace(policy, labels={**policy.labels, **labels})


def valid_values(facts_long: DataFrame, fields: list[str]) -> DataFrame:
    """(field_name, value): the distinct non-empty values of the policy's fields."""
    return facts_long.filter(F.col("field_name").isin(fields) & (F.coalesce("value", F.lit("")) != "")).select("field_name", "value").distinct()
