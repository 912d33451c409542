"""JSONL import of facts: normalise, number, dedupe against the pool and within the batch, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "fact_text string, category string, confidential_level string, summary string, keywords array<string>, paraphrases array<string>, negative_samples array<string>"


def blank_to(col: str, default) -> F.Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), default)


def numbered(rows: DataFrame, order: str, out: str = "number") -> DataFrame:
    """Numbers rows from 1 in ``order`` without a window over all of them: ranges of the order are sorted and counted, and
    each range starts where the ranges before it end. Equal keys share a range and are numbered among themselves."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    cuts = [r[0] for r in rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("c")).select(F.explode("c")).distinct().sort("col").collect()] if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    before = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # a row for each range
    ahead, total = [], 0
    for p in range(len(cuts) + 1):
        ahead.append(total)
        total += before.get(p, 0)
    start = F.element_at(F.array(*[F.lit(a).cast("long") for a in ahead]), F.col("_part") + 1)
    return rows.withColumn(out, start + F.row_number().over(Window.partitionBy("_part").orderBy(order))).drop("_part")


def normalise(parsed: DataFrame, order: str) -> DataFrame:
    """Rows with a fact_text, numbered in ``order``: id SEC-%06d-SHA1[:10], defaults, keywords joined by a full-width
    semicolon, trimmed paraphrases and negative samples."""
    rows = parsed.withColumn("fact_text", F.trim("fact_text")).filter("coalesce(fact_text, '') <> ''")
    digest = F.upper(F.substring(F.sha1(F.col("fact_text").cast("binary")), 1, 10))
    none = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda k: F.trim(k)), lambda k: k != "")
    return numbered(rows, order).select(
        order, F.format_string("SEC-%06d-%s", "number", digest).alias("id"), blank_to("category", F.lit("未分类")).alias("category"), blank_to("confidential_level", F.lit("high")).alias("confidential_level"),
        blank_to("summary", F.substring("fact_text", 1, 60)).alias("secret_summary"), F.col("fact_text").alias("secret_content"), F.array_join(clean("keywords"), "；").alias("secret_keywords"),
        clean("paraphrases").alias("attack_paraphrases"), clean("negative_samples").alias("negative_samples"),
    )


def fresh(rows: DataFrame, existing: DataFrame | None, order: str) -> DataFrame:
    """Rows whose content is not in the pool yet; of equal contents the first."""
    if existing is not None:
        rows = rows.join(existing.select("secret_content"), "secret_content", "left_anti")
    first = rows.groupBy("secret_content").agg(F.min(order).alias(order))
    return rows.join(first, ["secret_content", order], "left_semi")


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parsed columns and ``error``: lines that are no JSON object or lack fact_text."""
    rows = lines.withColumn("r", F.from_json(value, SCHEMA))
    bad = F.when(F.get_json_object(value, "$").isNull(), "bad json").when(F.coalesce(F.trim("r.fact_text"), F.lit("")) == "", "missing fact_text")
    return rows.select("*", "r.*", bad.alias("error")).drop("r")


# How many errors an import reports, and how much of a bad line.
ERRORS, PREVIEW, ALIASES = 20, 120, 20


def errors(parsed: DataFrame, order: str, value: str = "value") -> DataFrame:
    """(line, error, preview) of the first bad lines of an import."""
    bad = parsed.filter("error is not null").select(F.col(order).alias("line"), "error", F.substring(value, 1, PREVIEW).alias("preview"))
    return bad.orderBy("line").limit(ERRORS)


def import_lines(lines: DataFrame, existing: DataFrame | None, order: str, value: str = "value", replace: bool = False) -> dict[str, DataFrame]:
    """An import as tables: ``facts`` (the new ones), ``errors``, ``summary`` (lines, parsed, imported, duplicates, errors,
    total), ``categories`` and ``levels`` (value, n: over all parsed rows), ``aliases`` (canonical, terms).

    With ``replace`` the existing facts (secret_content) don't count. Blank lines are no lines.
    """
    parsed = parse(lines.filter(F.trim(value) != ""), value)
    rows = normalise(parsed.filter("error is null"), order)
    new = fresh(rows, None if replace else existing, order)
    kept = 0 if replace or existing is None else existing.count()
    summary = parsed.agg(F.count("*").alias("lines"), F.count("error").alias("errors")).crossJoin(new.agg(F.count("*").alias("imported")))  # one row each
    summary = summary.select("lines", (F.col("lines") - F.col("errors")).alias("parsed"), "imported", (F.col("lines") - F.col("errors") - F.col("imported")).alias("duplicates"), "errors", (F.col("imported") + kept).alias("total"))
    count = lambda c: rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return {"facts": new, "errors": errors(parsed, order, value), "summary": summary, "categories": count("category"), "levels": count("confidential_level"), "aliases": new.select("secret_content", import_aliases().alias("terms"))}


def import_aliases(old: F.Column | None = None) -> F.Column:
    """Terms that an imported fact adds to its content: what is there already, summary, keywords and paraphrases, once each, 20 at most."""
    none = F.array().cast("array<string>")
    terms = F.concat(old if old is not None else none, F.array("secret_summary"), F.split("secret_keywords", "；"), F.coalesce("attack_paraphrases", none))
    clean = F.transform(terms, lambda t: F.trim(t))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: (F.coalesce(t, F.lit("")) != "") & (t != F.col("secret_content")))), 1, ALIASES)


def list_kb(lines: DataFrame, order: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Records and errors (line, error) of knowledge-base lines in either form: ``content_units``, or ``content`` as one unit.

    The id is kb_id or doc_id; blank lines are skipped; units without text are left out.
    """
    schema = "kb_id string, doc_id string, topic string, title string, content string, retrieval_terms array<string>, content_units array<struct<unit_id:string,role:string,text:string>>, source string"
    rows = lines.filter(F.trim(value) != "").withColumn("r", F.from_json(value, schema))
    key = F.trim(F.coalesce(F.nullif("r.kb_id", F.lit("")), F.col("r.doc_id"), F.lit("")))
    error = F.when(F.get_json_object(value, "$").isNull(), "bad json").when(~F.trim(value).startswith("{"), "not an object").when(key == "", "missing kb_id/doc_id")
    rows = rows.withColumn("error", error).withColumn("kb_id", key)
    unit = lambda u: F.struct(F.trim(F.coalesce(u["unit_id"], F.lit(""))).alias("unit_id"), F.trim(F.coalesce(F.nullif(u["role"], F.lit("")), F.lit("content"))).alias("role"), F.trim(u["text"]).alias("text"))
    units = F.filter(F.transform("r.content_units", unit), lambda u: F.coalesce(u["text"], F.lit("")) != "")
    body = F.trim(F.coalesce("r.content", F.lit("")))
    whole = F.array(F.struct(F.lit("FULL").alias("unit_id"), F.lit("content").alias("role"), body.alias("text")))
    kind = "array<struct<unit_id:string,role:string,text:string>>"
    content = F.when(F.col("r.content_units").isNotNull(), units.cast(kind)).when(body != "", whole.cast(kind)).otherwise(F.array().cast(kind))
    good = rows.filter("error is null").select(
        F.col(order).alias("line"), "kb_id", F.trim(F.coalesce(F.nullif("r.topic", F.lit("")), F.nullif("r.title", F.lit("")), F.col("kb_id"))).alias("title"),
        F.coalesce("r.retrieval_terms", F.array().cast("array<string>")).alias("retrieval_terms"), content.alias("content_units"), F.coalesce("r.source", F.lit("")).alias("source"),
    )
    return good, rows.filter("error is not null").select(F.col(order).alias("line"), "error")


def strict_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Parsed JSON lines; a bad one fails the query. Blank lines are skipped."""
    return lines.filter(F.trim(value) != "").select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def preview(lines: DataFrame, value: str = "value") -> DataFrame:
    """(category, level, n) of lines that parse, and one row of nulls for those that don't: what an import would bring."""
    parsed = parse(lines.filter(F.trim(value) != ""), value)
    own = F.col("error").isNull()
    return parsed.select(F.when(own, blank_to("category", F.lit("未分类"))).alias("category"), F.when(own, blank_to("confidential_level", F.lit("high"))).alias("level")).groupBy("category", "level").agg(F.count("*").alias("n"))
