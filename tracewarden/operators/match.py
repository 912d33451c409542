"""Anchors: value, alias and rule matches of texts against vocabularies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import boundary_pattern, escape_regex, spans, stable_id

try:
    import ahocorasick
except ModuleNotFoundError:  # texts and terms then meet by shared trigrams at any size
    ahocorasick = None

# A vocabulary of so many terms and characters is held by every task; a larger one meets the texts by shared trigrams.
HELD_TERMS, HELD_CHARS = 100_000, 8_000_000
# Strength of match types.
PRIORITY = {"exact": 6, "alias": 5, "semantic": 4, "partial": 3, "inferred": 2, "ambiguous": 1}


def _held(terms: DataFrame, term: str) -> bool:
    """Whether a vocabulary has bounded rows and characters (both counted)."""
    size = terms.limit(HELD_TERMS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(term)), F.lit(0))).first()
    return ahocorasick is not None and size[0] <= HELD_TERMS and size[1] <= HELD_CHARS


def contains_join(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """Pairs whose text contains the term (ignoring case), in any script; empty and null terms match nothing.

    A vocabulary of bounded rows and characters (both counted) is compiled to one automaton, and every text is read
    once, whatever the number of terms. A larger one is joined on trigrams: a term's first one, carried with a hash of
    the text, then checked on the text. Terms of one or two characters are few and stay with the automaton.
    """
    terms = terms.filter(F.coalesce(F.length(term), F.lit(0)) > 0)
    if _held(terms, term):
        return _held_join(texts, terms, text, term)
    short, long = terms.filter(F.length(term) < 3), terms.filter(F.length(term) >= 3)
    body = F.lower(text)
    tri = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(body) - 2, F.lit(1))), lambda i: F.substr(body, i, F.lit(3))))
    hashed = texts.withColumn("_text", F.xxhash64(text))
    seen = hashed.select("_text", F.explode(tri).alias("_gram")).distinct()
    near = seen.join(long.withColumn("_gram", F.substring(F.lower(F.col(term)), 1, 3)), "_gram").drop("_gram")
    holds = F.contains(F.lower(text), F.lower(term))
    return hashed.join(near, "_text").filter(holds).drop("_text").unionByName(texts.join(F.broadcast(short), holds))


def containing(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """The rows whose text contains a term, as in ``contains_join``; without a shuffle where the vocabulary is held."""
    terms = terms.filter(F.coalesce(F.length(term), F.lit(0)) > 0)
    if _held(terms, term):
        return _held_hits(texts, terms, text, term)[0].drop("_hits")
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    return contains_join(rows, terms.select(F.col(term).alias("_term")), text, "_term").drop("_term").dropDuplicates(["_row"]).drop("_row")


def _held_join(texts: DataFrame, terms: DataFrame, text: str, term: str) -> DataFrame:
    hits, table = _held_hits(texts, terms, text, term)
    return hits.withColumn("_hit", F.explode("_hits")).drop("_hits").join(F.broadcast(table), "_hit").drop("_hit")


def _held_hits(texts: DataFrame, terms: DataFrame, text: str, term: str) -> tuple[DataFrame, DataFrame]:
    """The rows with terms and their numbers (``_hits``), and the terms by number (``_hit``)."""
    rows = [(i, *r) for i, r in enumerate(terms.withColumn("_low", F.lower(term)).collect())]  # HELD_TERMS at most
    spark, low = texts.sparkSession, {}
    for r in rows:
        low.setdefault(r[-1], []).append(r[0])
    rows = [r[:-1] for r in rows]
    held = spark.sparkContext.broadcast(list(low.items()))
    table = spark.createDataFrame(rows, T.StructType([T.StructField("_hit", T.IntegerType()), *terms.schema.fields]))
    schema = T.StructType([*texts.schema.fields, T.StructField("_hits", T.ArrayType(T.IntegerType()))])

    def run(batches):
        automaton = ahocorasick.Automaton()
        for word, ids in held.value:
            automaton.add_word(word, ids)
        if held.value:
            automaton.make_automaton()
        for batch in batches:
            found = [sorted({i for _, ids in automaton.iter(t) for i in ids}) if t and held.value else [] for t in batch.column("_low").to_pylist()]
            own = [batch.column(c) for c in range(batch.num_columns - 1)]
            out = pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int32()))], names=schema.names)
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return texts.withColumn("_low", F.lower(text)).mapInArrow(run, schema), table


def literal_anchors(texts: DataFrame, terms: DataFrame, boundaries: bool = False) -> DataFrame:
    """``texts``: (.., text); ``terms``: (field_name, canonical, term). Every non-overlapping hit with its span.

    Of ASCII texts a held vocabulary's automaton gives the spans as well; a pattern a term finds those of the others.
    """
    pattern = boundary_pattern(F.col("term")) if boundaries else F.concat(F.lit("(?iu)"), escape_regex(F.col("term")))
    found = spans(F.col("text"), pattern, F.length("term"))
    terms = terms.filter("term <> ''")
    if _held(terms, "term"):
        plain = texts.filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
        other = contains_join(texts.filter(F.col("text").rlike(r"[^\x00-\x7F]")), terms).withColumn("span", F.explode(found))
        hits = _ascii_spans(plain, terms, boundaries).unionByName(other)
    else:
        hits = contains_join(texts, terms).withColumn("span", F.explode(found))
    return hits.withColumn("start", F.col("span.start")).withColumn("end", F.col("span.end")).drop("span")


def _ascii_spans(texts: DataFrame, terms: DataFrame, boundaries: bool) -> DataFrame:
    """The hits of ``boundary_pattern`` (or of the plain term, ignoring case) in ASCII texts, each with its span."""
    rows = [(i, *r) for i, r in enumerate(terms.collect())]  # HELD_TERMS at most
    spark, low, place = texts.sparkSession, {}, terms.columns.index("term") + 1
    for r in rows:
        if r[place].isascii():
            low.setdefault(r[place].lower(), []).append(r[0])
    held = spark.sparkContext.broadcast(list(low.items()))
    table = spark.createDataFrame(rows, T.StructType([T.StructField("_hit", T.IntegerType()), *terms.schema.fields]))
    kind = T.StructType([T.StructField("hit", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*texts.schema.fields, T.StructField("_hits", T.ArrayType(kind))])
    edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_.-")
    at, arrow = texts.columns.index("text"), pa.list_(pa.struct([("hit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        automaton = ahocorasick.Automaton()
        for word, ids in held.value:
            automaton.add_word(word, (len(word), boundaries and (word[0].isalnum() or word[-1].isalnum()), ids))
        if held.value:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                hits, last, body = [], {}, text.lower()
                for stop, (n, word, ids) in automaton.iter(body) if held.value and body else ():
                    lo, hi = stop + 1 - n, stop + 1
                    if lo < last.get(ids[0], 0) or word and (lo and body[lo - 1] in edge or hi < len(body) and body[hi] in edge):
                        continue
                    last[ids[0]] = hi
                    hits.extend({"hit": i, "start": lo, "end": hi} for i in ids)
                out.append(hits)
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns)), pa.array(out, arrow)], names=schema.names)
            yield made.filter(pa.array([bool(x) for x in out], pa.bool_()))

    hits = texts.mapInArrow(run, schema).withColumn("_h", F.explode("_hits")).drop("_hits")
    hits = hits.select(*texts.columns, F.col("_h.hit").alias("_hit"), F.struct(F.col("_h.start").alias("start"), F.col("_h.end").alias("end")).alias("span"))
    return hits.join(F.broadcast(table), "_hit").drop("_hit")


def infer(anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """One pass of public rules: (field_name, canonical) implies (tgt_field, tgt_value); the first rule of a target wins.

    Where anchors have an ``anchor_id``, the inferred ones name it as their ``source_anchor_id``.
    """
    first = Window.partitionBy("src_field", "src_value", "tgt_field", "tgt_value").orderBy("ord")
    once = rules.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn", "ord")
    joined = anchors.join(once, (F.col("field_name") == F.col("src_field")) & (F.col("canonical") == F.col("src_value")))
    if "anchor_id" in anchors.columns:
        joined = joined.withColumn("source_anchor_id", F.col("anchor_id"))
    return joined.withColumn("field_name", F.col("tgt_field")).withColumn("canonical", F.col("tgt_value")).drop("src_field", "src_value", "tgt_field", "tgt_value").withColumn("inferred", F.lit(True))


def strength(match_type: F.Column) -> F.Column:
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(match_type == name, rank).otherwise(out)
    return out


def merge(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors with equal keys become one: greatest confidence, strongest match type, sources united; protected where
    one is, and accepted values in the order of the extractors, where anchors have them."""
    out = [F.max("confidence").alias("confidence"), F.max_by("match_type", strength(F.col("match_type"))).alias("match_type"), F.array_sort(F.collect_set("extractor")).alias("extractors"), F.count("*").alias("merged")]
    if "protected" in anchors.columns:
        out.append(F.max("protected").alias("protected"))
    if "accepted" in anchors.columns:
        out.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("extractor", "accepted"))), lambda x: x["accepted"]))).alias("accepted"))
    if "anchor_id" in anchors.columns:
        out.append(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("extractor", "anchor_id"))), lambda x: x["anchor_id"])).alias("merged_anchor_ids"))
    return anchors.groupBy(*keys).agg(*out)


def collapse(anchors: DataFrame, key: list[str]) -> DataFrame:
    """The best anchor of each (key.., source, field_name, canonical, inferred): by match type, confidence, length of text."""
    best = Window.partitionBy(*key, "source", "field_name", "canonical", "inferred").orderBy(strength(F.col("match_type")).desc(), F.desc("confidence"), F.length("text").desc(), "start", "end")
    return anchors.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def add_normalized(anchors: DataFrame, normalized: DataFrame, key: list[str]) -> DataFrame:
    """Normalised anchors whose (key.., source, field_name, canonical) no other anchor has, once each, under the others."""
    same = [*key, "source", "field_name", "canonical"]
    fresh = normalized.dropDuplicates(same).join(anchors.select(*same).distinct(), same, "left_anti")
    return anchors.unionByName(fresh, allowMissingColumns=True)


# Fields of confidential facts whose values are weak when short.
CONFIDENTIAL_FIELDS = ["secret_content", "secret_summary", "secret_keywords", "confidential_level", "attack_paraphrases"]


def weak_value(field: F.Column, value: F.Column) -> F.Column:
    """Values of confidential fields of fewer than four characters without white space and punctuation."""
    return field.isin(CONFIDENTIAL_FIELDS) & (F.length(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)[\s\W_]+", "")) < 4)


def vocabulary(facts_long: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(field_name, canonical, term, match_type): each value of the pool, and the aliases of canonical values; weak ones are left out."""
    own = facts_long.select("field_name", F.col("value").alias("canonical")).distinct()
    out = own.select("field_name", "canonical", F.col("canonical").alias("term"), F.lit("exact").alias("match_type"))
    if aliases is not None:
        out = out.unionByName(aliases.select("field_name", "canonical", "term", F.lit("alias").alias("match_type")))
    first = out.filter((F.coalesce("term", F.lit("")) != "") & ~weak_value(F.col("field_name"), F.col("term")))
    return first.groupBy("field_name", "canonical", "term").agg(F.max_by("match_type", strength(F.col("match_type"))).alias("match_type"))


def anchor_id(*columns: str) -> F.Column:
    return stable_id("A", *[F.col(c) for c in columns])
