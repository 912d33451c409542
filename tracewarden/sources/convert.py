"""Raw libraries turned into facts, policies and knowledge-base records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import content_units, retrieval_terms
from ..operators.kb import best_secret
from .resources import alias_terms

CHUNK = 500
# Fields of confidential facts in their order, with their labels, weights and replacements.
FIELDS = ["category", "secret_keywords", "secret_summary", "secret_content", "confidential_level"]
LABELS = {"id": "保密事实编号", "category": "保密类别", "confidential_level": "密级", "secret_summary": "保密摘要", "secret_content": "保密内容", "secret_keywords": "保密关键词"}
WEIGHTS = {"category": 0.1, "secret_keywords": 0.35, "secret_summary": 0.5, "secret_content": 1.0, "confidential_level": 0.3}
REPLACEMENTS = {"secret_summary": "相关保密信息", "secret_content": "相关保密内容", "secret_keywords": "相关关键词", "confidential_level": "相关密级", "category": "相关类别"}
SENSITIVE = ["secret_content", "secret_summary", "secret_keywords", "confidential_level"]


def facts(library: DataFrame) -> DataFrame:
    """Confidential facts of a library: keywords joined, nulls empty, lists kept."""
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return library.select(
        text("secret_id").alias("id"), text("category").alias("category"), text("confidential_level").alias("confidential_level"), text("secret_summary").alias("secret_summary"), text("secret_content").alias("secret_content"),
        F.array_join(F.coalesce("secret_keywords", none), "；").alias("secret_keywords"), F.coalesce("attack_paraphrases", none).alias("attack_paraphrases"), F.coalesce("negative_samples", none).alias("negative_samples"),
        text("source_kb_id").alias("source_kb_id"),
    )


def field_aliases(rows: DataFrame) -> DataFrame:
    """(field_name, canonical, term): the terms that stand for each fact's content."""
    terms = alias_terms(F.col("secret_content"), F.col("attack_paraphrases"), F.regexp_replace("secret_keywords", "；", " "), F.col("secret_summary"))
    return rows.filter("secret_content <> ''").select(F.lit("secret_content").alias("field_name"), F.col("secret_content").alias("canonical"), F.explode(terms).alias("term")).filter("term <> canonical")


def policy(aliases: dict[str, dict[str, list[str]]] | None = None) -> dict:
    """The policy of confidential facts."""
    return {
        "display_field": "secret_summary", "protected_fields": SENSITIVE, "identifier_fields": ["category"], "quasi_identifier_fields": ["category"], "field_order": FIELDS, "field_labels": LABELS,
        "field_weights": WEIGHTS, "field_aliases": aliases or {}, "public_rules": [], "sensitive_fields": SENSITIVE, "safe_replacements": REPLACEMENTS, "safe_hint": "具体保密内容应通过授权系统按权限查询。",
        "llm_confidence_threshold": 0.4, "llm_max_accepted_values": 30, "slot_detection_enabled": True, "confirmation_detection_enabled": True,
    }


def knowledge(records: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """(kb_id, topic, retrieval_terms, content_units) of documents (doc_id, title, content, department); those without id or
    content are left out. The terms take in the keywords of the secret whose keywords the document holds most."""
    rows = records.filter("coalesce(trim(doc_id), '') <> '' and coalesce(trim(content), '') <> ''")
    words = F.array().cast("array<string>")
    if secrets is not None:
        near = best_secret(rows, secrets).select("doc_id", "secret_id")
        rows = rows.join(near, "doc_id", "left").join(secrets.select("secret_id", F.col("secret_keywords").alias("_words")), "secret_id", "left")
        words = F.col("_words")
    topic = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("内部资料"))
    return rows.select(F.trim("doc_id").alias("kb_id"), topic.alias("topic"), retrieval_terms(F.col("title"), F.col("department"), words).alias("retrieval_terms"), content_units(F.col("content")).alias("content_units"))


def chunks(records: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """Adds ``chunk``: records in order, ``size`` to a chunk."""
    from .ingest import numbered

    return numbered(records, order).withColumn("chunk", F.floor((F.col("number") - 1) / size)).drop("number")
