"""Term extraction and normal forms as native column expressions (texts are folded by ``nfkc`` once, outside lambdas)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, grams, nfkc

STRINGS = "array<string>"
# Sentence data marks, splitting characters of facts and titles, places, and name parts of metadata.
DATA = r"[\d.]+|[百千万亿]元|TB|GB|分|台|次|人|个"
FACT_SPLIT = r"""[，。；;、：:\n\r\t！？!?（）()\[\]【】"'“”]+"""
TITLE_SPLIT = r"[0-9年月日\-—・·]+"
CITIES = "北京 上海 广州 深圳 杭州 南京 成都 武汉 重庆 天津 西安 苏州 长沙 郑州 青岛 大连 厦门 宁波 福州 合肥 济南 沈阳 哈尔滨 长春 昆明 贵阳 南宁 海口 乌鲁木齐 拉萨 兰州 银川 西宁 呼和浩特 石家庄 太原 南昌 无锡 东莞 佛山 珠海 三亚 桂林 丽江 大理 张家界 黄山".split()


def none() -> Column:
    return F.array().cast(STRINGS)


def squeeze(folded: Column) -> Column:
    """Lower case without white space, punctuation and underscores, of an NFKC text."""
    return F.regexp_replace(F.lower(F.replace(folded, F.lit("％"), F.lit("%"))), r"(?U)[\s\W_]+", "")


def squeeze_literal(term: str) -> str:
    """``squeeze`` of a fixed term, on the driver."""
    return re.sub(r"[\s\W_]+", "", unicodedata.normalize("NFKC", term).lower().replace("％", "%"))


def normalize_confirmation(text: Column) -> Column:
    """NFKC, lower case, without white space, punctuation and underscores; null is empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)[\s\W_]+", "")


def normalize_plain(value: Column) -> Column:
    """Trimmed and lower-cased; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))


def clean_amount(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[,，]", ""))


def safe_name(value: Column, most: int = 80, empty: str = "llm_call", dots: bool = False) -> Column:
    """File-name form: anything but letters, digits, ``_`` and ``-`` (and dots) becomes ``_``."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), rf"(?U)[^\p{{L}}\p{{N}}_{'.' if dots else ''}\-]", "_")
    return F.when(kept == "", empty).otherwise(F.substring(kept, 1, most))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the fixed terms; null holds none."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return F.coalesce(out, F.lit(False))


def has_city(text: Column) -> Column:
    return has_any(text, CITIES)


def stripped(terms: Column, least: int = 1) -> Column:
    """Trimmed terms of at least ``least`` characters; a null array is empty."""
    return F.filter(F.transform(F.coalesce(terms, none()), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: F.length(t) >= least)


def retrieval_terms(title: Column, department: Column, keywords: Column) -> Column:
    """Title parts between digits and dashes, the department, keywords: two characters or more, distinct, 20 at most."""
    parts = stripped(F.split(F.coalesce(title, F.lit("")), TITLE_SPLIT), 2)
    unit = stripped(F.array(F.coalesce(department, F.lit(""))))
    return F.slice(F.array_distinct(F.concat(parts, unit, stripped(keywords, 2))), 1, 20)


def content_units(content: Column) -> Column:
    """Array of (unit_id, role, text): sentences; the first is background, the last the boundary, others by whether they hold data."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = stripped(F.split(text, "(?<=[。！？])"))
    kind = "array<struct<unit_id:string,role:string,text:string>>"
    role = lambda p, i: F.when(i == 0, "background_context").when(i == F.size(parts) - 1, "response_boundary").when(p.rlike(DATA), "semantic_anchor_object").otherwise("semantic_anchor_background")
    units = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("U"), (i + 1).cast("string")).alias("unit_id"), role(p, i).alias("role"), p.alias("text")))
    whole = F.array(F.struct(F.lit("U1").alias("unit_id"), F.lit("content").alias("role"), text.alias("text")))
    return F.when(F.size(parts) == 0, whole.cast(kind)).otherwise(units.cast(kind))


def local_tokens(text: Column) -> Column:
    """Distinct runs of letters, digits, CJK, stars and dashes, and all 2-, 3- and 4-grams without white space."""
    runs = F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9{CJK}★\-]+)"), F.lit(1))
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    return F.array_distinct(F.concat(runs, grams(compact, 2), grams(compact, 3), grams(compact, 4)))


def without(text: Column, terms: list[str]) -> Column:
    """The text without the terms, the longest first."""
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        text = F.replace(text, F.lit(term), F.lit(""))
    return text


def slot_terms(question: Column, query_terms: list[str], connectors: list[str]) -> Column:
    """Signal terms of a slot question (a column folded by NFKC before): its words without query terms, also without connectors, and their 8- to 2-grams."""
    asked, joined = [squeeze_literal(t) for t in query_terms], [squeeze_literal(t) for t in connectors]
    words = F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"(?U)(\w+)"), F.lit(1)), squeeze), lambda w: F.length(w) >= 2)
    bare = F.filter(F.transform(words, lambda w: without(w, asked)), lambda w: F.length(w) >= 2)

    def parts(w: Column) -> Column:
        clean = without(w, joined)
        own = F.filter(F.array(clean, w), lambda x: F.length(x) >= 2)
        return F.concat(own, *[grams(clean, n) for n in (8, 6, 4, 3, 2)])

    found = F.array_distinct(F.flatten(F.transform(bare, parts)))
    return F.filter(found, lambda t: (t != "") & ~t.isin(asked)) if asked else found


def slot_values(answer: Column, question: Column, pattern: str, units: dict[str, str]) -> Column:
    """Values that a short answer (16 squeezed characters at most) can fill a slot with, bare numbers also with the units
    that the question hints at; eight at most. Both are columns folded by NFKC before; ``pattern`` has no capturing group."""
    text, asked = F.trim(answer), squeeze(question)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), squeeze)
    whole = F.when(text.rlike(f"^(?:{pattern})$"), F.array(squeeze(text))).otherwise(none())
    values = F.filter(F.array_distinct(F.concat(whole, found)), lambda v: v != "")
    hinted = [F.when(F.contains(asked, F.lit(word)), F.lit(unit)) for word, unit in units.items()]
    fitting = F.array_compact(F.array(*hinted)).cast(STRINGS) if hinted else none()
    with_unit = F.flatten(F.transform(F.filter(values, lambda v: v.rlike(r"^\d+(?:\.\d+)?$")), lambda v: F.transform(fitting, lambda u: F.concat(v, u))))
    short = (text != "") & (F.length(squeeze(text)) <= 16)
    return F.when(short, F.slice(F.array_distinct(F.concat(values, with_unit)), 1, 8)).otherwise(none())


def fact_fragments(values: Column, common: list[str]) -> Column:
    """Terms of protected texts, the longest first: clauses of four or more, and 4- to 8-grams of their CJK runs that are
    not (nearly) common fragments."""
    clauses = F.flatten(F.transform(values, lambda v: stripped(F.split(v, FACT_SPLIT), 4)))
    runs = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(F.regexp_replace(F.lower(v), r"(?U)[\s\W_]+", ""), F.lit(f"([{CJK}]{{4,}})"), F.lit(1))))
    every = F.flatten(F.transform(runs, lambda r: F.concat(*[grams(r, n) for n in range(4, 9)])))
    if common:
        plain = F.array(*[F.lit(c) for c in common])
        every = F.filter(every, lambda g: ~F.exists(plain, lambda c: F.contains(g, c) & (F.length(g) <= F.length(c) + 1)))
    return F.array_sort(F.array_distinct(F.concat(clauses, every)), lambda a, b: F.length(b) - F.length(a))


# What a question starts and ends with around its subject.
ASK_TAIL, ASK_HEAD = r"(?U)[？?。！!，,；;：:\s]+$", "^(请问|请告知|请查询|查询一下|查一下|查询|请|问)"
ASK_WORDS = ["为多少分", "是多少分", "多少分", "几分", "为多少", "是多少", "是什么", "多少", "吗", "呢"]


def slot_subject(question: Column) -> Column:
    """What a slot question asks about: 4 to 80 characters, else empty."""
    text = F.regexp_replace(F.regexp_replace(F.trim(nfkc(F.coalesce(question, F.lit("")))), ASK_TAIL, ""), ASK_HEAD, "")
    text = F.regexp_replace(F.regexp_replace(without(text, ASK_WORDS), "[为是的]+$", ""), r"(?U)\s+", "")
    return F.when(F.length(text).between(4, 80), text).otherwise("")


def slot_context(question: Column, query_terms: list[str]) -> Column:
    """The question without its query terms, 80 characters at most."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), ASK_TAIL, ""), "^(请问|请告知|请查询|查询|请|问)", "")
    return F.substring(F.regexp_replace(without(text, query_terms), "[为是的]+$", ""), 1, 80)


# What separates the parts of a collateral description.
PARTS_SPLIT = r"[、，,和及以;；]"


def component_matches(texts, values, key: str, text: str = "text", field_rank: str = "position"):
    """(key, component, canonical) of the parts (three characters or more) of the pool's values that a text contains,
    ignoring case; of values with an equal part the first in the pool counts. ``values``: (value, position)."""
    from ..operators.match import contains_join

    parts = values.select("value", field_rank, F.explode(stripped(F.split("value", PARTS_SPLIT), 3)).alias("term"))
    first = parts.groupBy("term").agg(F.min_by("value", field_rank).alias("canonical"))
    return contains_join(texts, first, text, "term").select(key, F.col("term").alias("component"), "canonical").distinct()


# Words in a field's name that tell how its values are normalised.
FIELD_KINDS = {
    "amount": ["amount", "金额", "费用", "fee", "salary", "wage"],
    "rate": ["rate", "利率", "利息", "lpr", "bp"],
    "rating": ["rating", "评级", "信用", "等级", "score"],
    "date": ["date", "日期", "时间", "申请", "到期", "创建", "更新"],
}


def field_kinds(field: str) -> list[str]:
    """The normalisers that a field's name calls for, in their order."""
    return [kind for kind, words in FIELD_KINDS.items() if any(w in field.lower() for w in words)]


def normalized_anchors(texts, fields: list[str], key: list[str], text: str = "text"):
    """(key.., field_name, raw, canonical) of amounts, rates, ratings and dates for the fields that call for them; equal
    (field, canonical, raw) of a text count once. Amounts below 10000 are noise."""
    from .text import normalized_values

    named = [(field, kind) for field in fields for kind in field_kinds(field)]
    if not named:
        return texts.select(*key, F.lit("").alias("field_name"), F.lit("").alias("raw"), F.lit("").alias("canonical")).filter("false")
    table = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind")) for f, k in named])
    found = texts.select(*key, F.explode(normalized_values(F.col(text))).alias("v"))
    rows = found.select(*key, "v.*", F.explode(F.filter(table, lambda x: x["kind"] == F.col("v.kind"))).alias("f"))
    return rows.select(*key, F.col("f.field_name").alias("field_name"), "raw", "canonical").distinct()
