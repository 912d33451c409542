"""Anchors, retrieval, routing, redaction and ingestion over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, detect, kb, match, redact, retrieve, route
from ..sources import audit, ingest
from .tables import table

TERMS = [("en", "article", "the"), ("en", "relative", "that"), ("de", "article", "die"), ("fr", "article", "les"), ("es", "article", "los"), ("en", "verb", "was")]
TERM_VALUES = ", ".join(map(str, TERMS))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each benchmark item as a term."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^([^.]*\.)", 1).alias("term")).filter("length(term) >= 4")


PASSAGES_SQL = "p as (select item_id, regexp_extract(text, '^([^.]*\\.)', 1) as term from benchmark where length(regexp_extract(text, '^([^.]*\\.)', 1)) >= 4)"


def literal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.literal_anchors(_documents(spark, sf_dir), _passages(spark, sf_dir)).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


LITERAL_ANCHORS = f"""
with {PASSAGES_SQL},
h as (select doc_id, item_id, length(term) as n, string_split(lower(text), lower(term)) as parts from documents join p on contains(lower(text), lower(term))),
x as (select doc_id, item_id, n, i, list_sum(list_transform(parts[1:i], lambda s: length(s))) + (i - 1) * n as start from (select *, unnest(range(1, len(parts))) as i from h))
select doc_id, item_id, cast(start as bigint) as start, cast(start + n as bigint) as "end" from x
"""


def boundary_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import boundary_pattern

    terms = spark.createDataFrame(TERMS, "lang string, kind string, term string")
    hits = F.regexp_count("text", boundary_pattern(F.col("term")))
    return _documents(spark, sf_dir).join(F.broadcast(terms.select("term")), F.contains(F.lower("text"), F.col("term"))).select("doc_id", "term", hits.cast("long").alias("hits")).filter("hits > 0")


BOUNDARY_LITERALS = f"""
select doc_id, term, cast(len(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_.\\-]+'), lambda x: x = term)) as bigint) as hits
from documents, (values {TERM_VALUES}) v(field, kind, term) where len(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_.\\-]+'), lambda x: x = term)) > 0
"""


def alias_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([(lang, kind, term) for lang, kind, term in TERMS], "field_name string, canonical string, term string")
    hits = match.contains_join(_documents(spark, sf_dir), aliases)
    return hits.groupBy("doc_id", "field_name", "canonical").agg(F.count("*").alias("terms"))


ALIAS_ANCHORS = f"""
select doc_id, field as field_name, kind as canonical, count(*) as terms from documents, (values {TERM_VALUES}) v(field, kind, term) where contains(lower(text), term) group by 1, 2, 3
"""


def anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    make = lambda rows: spark.createDataFrame(rows, "field_name string, canonical string, term string, match_type string, confidence double, extractor string")
    exact = make([(lang, kind, term, "exact", 1.0, "rule") for lang, kind, term in TERMS])
    loose = make([(lang, kind, term[:2], "partial", 0.6, "loose") for lang, kind, term in TERMS])
    hits = match.contains_join(docs, exact.unionByName(loose))
    merged = match.merge(hits, ["doc_id", "field_name", "canonical"])
    return merged.select("doc_id", "field_name", "canonical", "confidence", "match_type", F.array_join("extractors", ",").alias("extractors"), "merged")


ANCHOR_MERGE = f"""
with t as (select field, kind, term, 'exact' as m, 1.0 as c, 'rule' as x from (values {TERM_VALUES}) v(field, kind, term)
  union all select field, kind, term[1:2], 'partial', 0.6, 'loose' from (values {TERM_VALUES}) v(field, kind, term))
select doc_id, field as field_name, kind as canonical, cast(max(c) as double) as confidence, case when bool_or(m = 'exact') then 'exact' else 'partial' end as match_type,
  string_agg(distinct x, ',' order by x) as extractors, count(*) as merged
from documents join t on contains(lower(text), term) group by 1, 2, 3
"""

DIGITS = 9  # sums of floats differ in their last digits by the order of addition: ranks go by so many
WORDS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _words() -> F.Column:
    return F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))


def _pairs() -> F.Column:
    """Word pairs; the last word has no partner."""
    return F.filter(F.zip_with(_words(), F.slice(_words(), 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    postings, stats = retrieve.index(docs, _words(), "doc_id")
    queries = items.select("item_id", F.explode(F.array_distinct(_words())).alias("token"))
    bm = retrieve.bm25(queries, postings, stats, retrieve.average_length(docs, _words()), "item_id", "doc_id")
    postings2, stats2 = retrieve.index(docs, _pairs(), "doc_id")
    queries2 = items.select("item_id", F.explode(F.array_distinct(_pairs())).alias("token"))
    return bm, retrieve.overlap(queries2, postings2, stats2, "item_id", "doc_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm, _ = _scores(spark, sf_dir)
    return retrieve.cut_top(bm.withColumn("score", F.round("bm25", DIGITS)), "item_id", None, "doc_id", top=5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_BM_SQL = f"""
w as (select doc_id, {WORDS_SQL} as w from documents), len as (select doc_id, len(w) as n from w), st as (select count(*) as total, avg(n) as avgdl from len),
tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from w) group by 1, 2),
df as (select t, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, st group by t, total),
q as (select distinct item_id, unnest({WORDS_SQL}) as t from benchmark),
bm as (select item_id, tf.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl))) as s from q join df using (t) join tf using (t) join len on len.doc_id = tf.doc_id, st group by 1, 2)"""
BM25_TOPK = f"""
with {_BM_SQL}, r as (select item_id, doc_id, round(s, 6) as score, row_number() over (partition by item_id order by round(s, {DIGITS}) desc, doc_id) as rank from bm where round(s, {DIGITS}) >= 0.08)
select item_id, doc_id, score, rank from r where rank <= 5
"""


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ng = _scores(spark, sf_dir)
    return retrieve.cut_top(ng.withColumn("score", F.round("ngram", DIGITS)), "item_id", None, "doc_id", top=5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _bigram_sql(column: str) -> str:
    return f"list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1])"


_NG_SQL = f"""
w2 as (select doc_id, {_bigram_sql('w')} as w from (select doc_id, {WORDS_SQL} as w from documents)), tf2 as (select distinct doc_id, unnest(w) as t from w2),
df2 as (select t, ln(1 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf2 group by t),
q2 as (select distinct item_id, unnest({_bigram_sql('w')}) as t from (select item_id, {WORDS_SQL} as w from benchmark)),
qw as (select item_id, sum(coalesce(idf, 0.1)) as whole from q2 left join df2 using (t) group by 1),
ng as (select q2.item_id, doc_id, sum(idf) / any_value(whole) as s from q2 join df2 using (t) join tf2 using (t) join qw on qw.item_id = q2.item_id group by 1, 2)"""
NGRAM_OVERLAP = f"""
with {_NG_SQL}, r as (select item_id, doc_id, round(s, 6) as score, row_number() over (partition by item_id order by round(s, {DIGITS}) desc, doc_id) as rank from ng where round(s, {DIGITS}) >= 0.08)
select item_id, doc_id, score, rank from r where rank <= 5
"""


def fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for items by all four signals: the item's first sentence is its canonical term, its source a field with a hint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("field_name"))
    terms = _passages(spark, sf_dir).withColumn("kind", F.lit("canonical"))
    rows = retrieve.held_scores(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), terms, _words(), "item_id", "doc_id", "field_name", per_field=2)
    if rows is None:
        bm, ng = _scores(spark, sf_dir)
        hits = retrieve.alias_scores(docs, terms, "doc_id", "item_id").select("item_id", "doc_id", "alias")
        rows = bm.join(ng, ["item_id", "doc_id"], "left").join(hits, ["item_id", "doc_id"], "left").fillna(0.0, ["ngram", "alias"]).join(docs.select("doc_id", "field_name"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("asked"))
    hints = retrieve.field_hint(F.col("asked"), F.substring("field_name", -1, 1), {"1": ["the", "that"], "2": ["the"]})
    rows = rows.join(asked, "item_id").withColumn("score", F.round(retrieve.fuse(F.col("bm25"), F.col("ngram"), F.col("alias"), hints), DIGITS))
    return retrieve.cut_top(rows, "item_id", "field_name", "doc_id", per_field=2, top=8).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


FUSED = f"""
with {_BM_SQL}, {_NG_SQL}, {PASSAGES_SQL}, al as (select item_id, doc_id, 3.5 as a from documents join p on contains(lower(text), lower(term))),
hi as (select item_id, contains(lower(text), 'the') as t, contains(lower(text), 'that') as u from benchmark),
f as (select bm.item_id, bm.doc_id, coalesce(d.source, '') as source, round(0.45 * (coalesce(a, 0) / (coalesce(a, 0) + 1)) + 0.30 * (bm.s / (bm.s + 1)) + 0.20 * coalesce(ng.s, 0)
    + 0.05 * case right(coalesce(d.source, ''), 1) when '1' then case when t and u then 1.0 when t or u then 0.5 else 0 end when '2' then case when t then 0.5 else 0 end else 0 end, {DIGITS}) as score
  from bm left join ng on ng.item_id = bm.item_id and ng.doc_id = bm.doc_id left join al on al.item_id = bm.item_id and al.doc_id = bm.doc_id join documents d on d.doc_id = bm.doc_id join hi on hi.item_id = bm.item_id),
k as (select *, row_number() over (partition by item_id, source order by score desc, doc_id) as n from f where score >= 0.08), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from k where n <= 2)
select item_id, doc_id, round(score, 6) as score, rank from r where rank <= 8
"""

ROUTES = [("english", r"\b(the|that|with)\b", 0.5), ("english", r"\b(was|is|are)\b", 0.3), ("french", r"\b(les|une|que)\b", 0.6), ("german", r"\b(der|die|das)\b", 0.6), ("spanish", r"\b(los|las|del)\b", 0.6), ("question", r"\?", 0.7)]


def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return route.classify(rows, ROUTES, "key").select("key.conv_id", "key.turn", "domain", F.round("confidence", 6).alias("confidence"))


def _routes_sql() -> str:
    domains = list(dict.fromkeys(d for d, _, _ in ROUTES))
    cols = ", ".join(f"1 - {' * '.join(f'(case when regexp_matches(b, \'{p}\') then {1 - w} else 1 end)' for d, p, w in ROUTES if d == name)} as {name}" for name in domains)
    best = f"greatest({', '.join(domains)})"
    pick = " ".join(f"when {d} = {best} then '{d}'" for d in domains)
    return f"""with c as (select conv_id, turn, lower(coalesce(text, '')) as b from conversations), s as (select conv_id, turn, b, {cols} from c)
select conv_id, turn, case when trim(b) <> '' and {best} >= 0.55 then case {pick} end else 'general' end as domain,
  round(cast(case when trim(b) = '' then 0.5 when {best} >= 0.55 then {best} else 0.3 end as double), 6) as confidence from s"""


def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(claims.segments(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("claim", "s"))
    return rows.select("conv_id", "turn", F.col("claim").cast("long").alias("claim"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.sha2("s.text", 256).alias("text_sha256"))


SENTENCE_CLAIMS = r"""
with c as (select row_number() over () as r, conv_id, turn, coalesce(text, '') as t from conversations),
p as (select *, regexp_split_to_array(t, '[.!?\n]+') as parts, list_concat(regexp_extract_all(t, '[.!?\n]+'), ['']) as marks from c),
x as (select r, conv_id, turn, i, parts[i] as s, list_sum(list_transform(parts[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(marks[1:i - 1], lambda v: length(v))), 0) as e
  from (select *, unnest(range(1, len(parts) + 1)) as i from p))
select conv_id, turn, row_number() over (partition by r order by i) - 1 as claim, cast(e - length(s) as bigint) as start, cast(e as bigint) as "end", sha256(s) as text_sha256 from x where trim(s) <> ''
"""


def direct_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose first sentence a document holds, in any width, case and spacing, and the markers it holds."""
    values = _passages(spark, sf_dir).select(F.col("item_id").alias("value_id"), "term")
    found = detect.direct_leaks(_documents(spark, sf_dir), values, "doc_id")
    return found.groupBy("doc_id").agg(F.count_distinct("value_id").alias("leaked_values"), F.count(F.when(F.col("value_id").isNull(), 1)).alias("markers"))


_FOLD = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_MARKS = " + ".join(f"case when contains(text, '{m}') or contains(f, '{detect.squeeze_space(m)}') then 1 else 0 end" for m in detect.MARKERS)
DIRECT_LEAKS = f"""
with {PASSAGES_SQL}, d as (select doc_id, text, {_FOLD.format('text')} as f from documents), v as (select item_id, {_FOLD.format('term')} as t from p),
h as (select doc_id, count(distinct item_id) as n from d join v on contains(f, t) group by 1), m as (select doc_id, {_MARKS} as k from d)
select doc_id, coalesce(n, 0) as leaked_values, k as markers from m left join h using (doc_id) where coalesce(n, 0) + k > 0
"""

# The kinds of personal and sensitive data that are flagged.
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "dotted_quad": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "long_digits": r"[0-9]{9,}", "licence": r"(?i)licen[cs]e|copyright", "money": r"[$€£][0-9][0-9,.]*"}


def pii_amount_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in KINDS.items()])


PII_FLAGS = "select doc_id, " + ", ".join(f"cast(len(regexp_extract_all(text, '{p}')) as bigint) as {k}" for k, p in KINDS.items()) + " from documents"


def redact_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for kind in ("email", "dotted_quad", "long_digits"):
        text = F.regexp_replace(text, KINDS[kind], f"[{kind}]")
    return _documents(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("redacted_sha256"), (text != F.col("text")).alias("changed"))


_RED = "text"
for _k in ("email", "dotted_quad", "long_digits"):
    _RED = f"regexp_replace({_RED}, '{KINDS[_k]}', '[{_k}]', 'g')"
REDACT = f"select doc_id, sha256({_RED}) as redacted_sha256, {_RED} <> text as changed from documents"


def x_replace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    safe = redact.fold(F.col("text"), F.array(*[F.lit(t) for _, _, t in TERMS]))
    return docs.select("doc_id", F.length(safe).cast("long").alias("length"), (safe != F.col("text")).alias("changed"))


_RUNS = r"regexp_split_to_array(lower(text), '[^A-Za-z0-9_.\-]+')"
_SAVED = " + ".join(f"{len(t) - 1} * len(list_filter({_RUNS}, lambda x: x = '{t}'))" for _, _, t in TERMS)
X_FOLD = f"select doc_id, cast(length(text) - ({_SAVED}) as bigint) as length, ({_SAVED}) > 0 as changed from documents"


def _region_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers ask for the code of their region; every other answer is another region's. Regions are the facts."""
    region = table(spark, sf_dir, "region")
    facts = region.select(F.col("r_regionkey").alias("fact_id"), F.lit("secret_content").alias("field_name"), F.concat_ws(" ", "r_name", F.lit("code"), "r_regionkey").alias("text"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").join(region, "r_regionkey")
    answer = F.when(F.col("s_suppkey") % 2 == 0, F.col("r_regionkey")).otherwise((F.col("r_regionkey") + 1) % 5)
    return rows.select(F.col("s_suppkey").alias("turn_id"), F.concat("r_name", F.lit(" code 预算是多少？")).alias("user_input"), answer.cast("string").alias("model_output")), facts


def slot_restoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, facts = _region_turns(spark, sf_dir)
    return detect.slot_restorations(turns, facts).select("turn_id", "fact_id", F.array_join("restored_fields", ",").alias("restored_fields"))


_WORDS = "list_concat(regexp_extract_all(lower(r_name), '[a-z0-9]+'), ['code'])"
_TERMS = "flatten(list_transform(" + _WORDS + ", lambda w: flatten([[w], " + ", ".join(f"list_transform(range(1, length(w) - {n - 2}), lambda i: substr(w, i, {n}))" for n in (8, 6, 4, 3, 2)) + "])))"
SLOTS = f"""
with t as (select s_suppkey, case when s_suppkey % 2 = 0 then r_regionkey else (r_regionkey + 1) % 5 end as v, list_filter({_TERMS}, lambda x: length(x) >= 3) as terms from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
f as (select r_regionkey, regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') || 'code' || r_regionkey as fact from region),
m as (select s_suppkey, r_regionkey, list_filter(terms, lambda x: contains(fact, x)) as strong from t join f on contains(fact, cast(v as varchar))),
h as (select * from m where len(list_filter(strong, lambda x: length(x) >= 8)) > 0 or len(list_filter(strong, lambda x: not contains(strong[1], x) and not contains(x, strong[1]))) > 0)
select s_suppkey as turn_id, min(r_regionkey) as fact_id, 'secret_content' as restored_fields from h group by 1 having count(*) = 1
"""


def confirmation_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' hypotheses about their nation, which answers confirm, echo in full, echo in part or refuse to confirm."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    name, rest = F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit(" key "), F.col("s_nationkey").cast("string"))
    kind = F.col("s_suppkey") % 4
    answer = F.when(kind == 0, F.concat(name, F.lit(" 正确"))).when(kind == 1, F.concat(name, F.lit(" and "), rest)).when(kind == 2, F.concat(name, F.lit(" only"))).otherwise(F.concat(F.lit("无法提供 "), name, F.lit(" 正确")))
    turns = rows.select(F.col("s_suppkey").alias("turn_id"), answer.alias("model_output"))
    single = rows.select(F.col("s_suppkey").alias("turn_id"), F.col("s_nationkey").alias("fact_id"), F.array(F.lit("secret_content")).alias("restored_fields"))
    facts = nation.select(F.col("s_nationkey").alias("fact_id"), F.concat(name, F.lit("；"), rest).alias("text"))
    return detect.confirmations(turns, single, facts).select("turn_id", "fact_id", F.size("signals").alias("signals"))


CONFIRMED = "select s_suppkey as turn_id, s_nationkey as fact_id, case when s_suppkey % 4 = 0 then 1 else 2 end as signals from supplier where s_suppkey % 4 < 2"


def kb_rank_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as queries against documents as records: the topic is the source, the terms are long words of the first line."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("q"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("([a-z]{9,})"), F.lit(1)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower("text").alias("body"), words.alias("terms"))
    return kb.rank_all(items, docs, "item_id", "doc_id", "q", "source", "terms", "body")


def unit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each source's three longest documents: at most five a document by role, twelve in all."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    top = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter(F.col("rank") <= kb.RECORDS)
    units = top.select("source", "doc_id", "rank", F.posexplode(F.split("text", r"\n")).alias("ord", "unit")).filter("trim(unit) <> ''")
    units = units.withColumn("role_rank", F.when(F.col("unit").rlike("[0-9]"), 0).when(F.col("ord") == 0, 1).otherwise(2))
    picked = kb.select_units(units, "source")
    return picked.select("source", "doc_id", F.col("ord").cast("long").alias("ord"), "role_rank", F.col("position").cast("long").alias("position"))


UNIT_SELECTION = r"""
with t as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents),
u as (select source, doc_id, rank, i - 1 as ord, parts[i] as unit from (select *, unnest(range(1, len(parts) + 1)) as i from (select *, string_split(text, chr(10)) as parts from t where rank <= 3))),
r as (select *, case when regexp_matches(unit, '[0-9]') then 0 when ord = 0 then 1 else 2 end as role_rank from u where trim(unit) <> ''),
a as (select *, row_number() over (partition by source, rank order by role_rank, ord) as n from r),
b as (select *, row_number() over (partition by source order by rank, n) as position from a where n <= 5)
select source, doc_id, ord, role_rank, position from b where position <= 12
"""


def import_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("props").alias("fact_text"), F.col("event_type").alias("category"))).alias("value"))
    rows = ingest.normalise(ingest.parse(events).filter("error is null"), "event_id")
    return ingest.fresh(rows, None, "event_id").select("event_id", "id", "category", "confidential_level", "secret_summary", "secret_content", "secret_keywords")


IMPORT = """
with v as (select event_id, trim(props) as f, event_type, row_number() over (order by event_id) as n from events where coalesce(trim(props), '') <> '')
select event_id, printf('SEC-%06d-%s', n, upper(substr(sha1(f), 1, 10))) as id, coalesce(nullif(trim(event_type), ''), '未分类') as category, 'high' as confidential_level,
  substr(f, 1, 60) as secret_summary, f as secret_content, '' as secret_keywords from v where event_id = (select min(event_id) from v w where w.f = v.f)
"""


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.col("props").alias("user_input"), F.lit("").alias("model_output"), "value")
    rec = audit.record(rows, ["event_type", "user_id"])
    return rec.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("user_input_hash").alias("first_hash"), F.round(F.max("value"), 6).alias("max_value"))


AUDIT = "select event_type, count(*) as n, count(distinct user_id) as users, min(sha256(coalesce(props, ''))) as first_hash, round(max(value), 6) as max_value from events group by 1"


def streaming_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router over the conversations as a stream, run to its end and read back."""
    import uuid

    from ..storage import shared_folder
    from ..streaming.turns import stream

    base = shared_folder(spark)
    out = f"{base}/stream-{uuid.uuid4().hex}"
    # A stream reads folders: where the table is one file, its folder is filtered by name.
    schema = table(spark, sf_dir, "conversations").schema
    analyse = lambda df: route.classify(df.select(F.struct("conv_id", "turn").alias("key"), "text"), ROUTES, "key").select("key.*", "domain", "confidence")
    stream(spark, f"{sf_dir}/conversations.parque[t]", schema, analyse, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("domain").agg(F.count("*").alias("n"))


STREAM_SQL = f"with routed as ({_routes_sql()}) select domain, count(*) as n from routed group by 1"

QUERIES = {f.__name__: f for f in (literal_anchors, boundary_literals, alias_anchors, anchor_merge, bm25_topk, ngram_overlap, fused_retrieval, intent_router, sentence_claims, direct_leak_scan, pii_amount_flags, redact_patterns, x_replace_fold, slot_restoration, confirmation_echo, kb_rank_catalog, unit_selection, import_normalise, audit_rollup, streaming_turns)}
SQL = {
    "literal_anchors": LITERAL_ANCHORS, "boundary_literals": BOUNDARY_LITERALS, "alias_anchors": ALIAS_ANCHORS, "anchor_merge": ANCHOR_MERGE, "bm25_topk": BM25_TOPK, "ngram_overlap": NGRAM_OVERLAP,
    "fused_retrieval": FUSED, "intent_router": _routes_sql(), "sentence_claims": SENTENCE_CLAIMS, "direct_leak_scan": DIRECT_LEAKS, "x_replace_fold": X_FOLD, "slot_restoration": SLOTS, "confirmation_echo": CONFIRMED, "pii_amount_flags": PII_FLAGS, "redact_patterns": REDACT,
    "unit_selection": UNIT_SELECTION, "import_normalise": IMPORT, "audit_rollup": AUDIT, "streaming_turns": STREAM_SQL,
}
