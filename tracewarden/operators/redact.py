"""Redaction: ordered folds of literal and pattern replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundary_pattern, escape_regex
from .analyze import Policy
from .match import contains_join

# Sweeps of amounts, rates, ratings and collateral, fields swept by known values, and the mark of bare ids.
SWEEPS = {
    "loan_amount": [r"(?:人民币|RMB|CNY)?\s*\d[\d,，]*\.?\d*\s*(?:亿|万)\s*(?:元|块|CNY|RMB)?"],
    "interest_rate": [r"(?i)LPR\s*[+\-加]\s*\d{2,4}\s*(?:个)?\s*(?:BP|bp|基点|个基点)?", r"（?年化\d+\.?\d*%\s*(?:）?\)?)?"],
    "credit_rating": [r"(?<![A-Za-z])(?:AAA|AA|A|BBB|BB|B|CCC|CC|C)\s*[+＋\-－]?(?:级)?(?![A-Za-z])", r"(?:信用|主体)评级(?:AAA|AA|A|BBB|BB|B|CCC|CC|C)\s*[+＋\-－]?"],
    "collateral": [
        r"有[^。；，,；;]{0,30}?(?:担保函|抵押|质押)[^。；，,；;]{0,10}", r"以[^。；，,；;]{0,30}?(?:研发大楼|担保函|抵押|质押|产线|厂房)[^。；，,；;]{0,10}",
        r"[^。；，,；;]*?(?:担保函|抵押|质押|研发大楼|产线|厂房|设备|股权质押|专利权|专利质押|担保物|抵押物|质权)[^。；，,；;]*",
    ],
}
KNOWN_VALUE_FIELDS = ["diagnosis", "medication", "treatment"]
BARE_ID, BARE_ID_MARK = r"(?<![A-Za-z0-9])([A-Z])[A-Z]{0,2}\d{2,4}(?![A-Za-z0-9])", "[$1类编号]"
# Placeholders that are safe as they are, the general one, the hint and the last resorts.
PLACEHOLDERS = ["相关对象", "相关业务域", "相关环境", "相关系统", "受影响版本", "相关风险状态", "相关处置状态", "远程入口", "相关事实", "已省略"]
REPLACEMENT = "相关事实"
HINT = "具体资产名称、系统类型、组件版本和处置状态应通过授权资产管理系统查询。"
DEFAULTS = {"system_name": "相关对象", "business_domain": "相关业务域", "environment": "相关环境", "function_category": "相关系统", "component_version": "受影响版本", "risk_status": "相关风险状态", "disposition_status": "相关处置状态", "remote_entry": "远程入口"}
FALLBACK = "该问题涉及可能受限的内部信息。请通过授权系统查询，或联系具备相应权限的人员处理。"
DEMO_MARK, DEMO_HIDDEN = "[已脱敏:受保护事实]", "[LLM 原始回答命中保密事实，已由后端脱敏隐藏。]"
SENTENCE = r"[^。！？!?；;\n]"


def fold(text: Column, terms: Column, replacement: str = "X") -> Column:
    """Replaces the terms (array of strings), the longest first; letters ignore case, alphanumeric edges must not run on."""
    ordered = F.array_sort(F.filter(terms, lambda t: t != ""), lambda a, b: F.length(b) - F.length(a))
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.aggregate(ordered, text, lambda acc, t: F.regexp_replace(acc, boundary_pattern(t), F.lit(safe)))


def span_replace(text: Column, start: Column, end: Column, expected: Column, replacement: Column) -> Column:
    """Replaces [start, end) where it still holds the expected text."""
    return F.when(F.substr(text, start + 1, end - start) == expected, F.overlay(text, replacement, start + 1, end - start)).otherwise(text)


def literal(replacement: str) -> str:
    """A replacement that a pattern replaces with as it stands."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def sweep(text: Column, fields: dict[str, str], known: dict[str, list[str]] | None = None) -> Column:
    """Pattern sweeps of the given fields with their safe replacements; ``known`` has the values (two characters or more)
    of fields that are swept by value, the longest first."""
    for name, replacement in fields.items():
        for pattern in SWEEPS.get(name, []):
            text = F.regexp_replace(text, pattern, literal(replacement))
        if name in KNOWN_VALUE_FIELDS:
            for value in sorted({v for v in (known or {}).get(name, []) if len(v) >= 2}, key=lambda v: (-len(v), v)):
                text = F.replace(text, F.lit(value), F.lit(replacement))
    return text


def mask_ids(text: Column) -> Column:
    return F.regexp_replace(text, BARE_ID, BARE_ID_MARK)


def collapse(text: Column, placeholders: list[str]) -> Column:
    """Repeated placeholders become one."""
    for p in sorted(placeholders, key=len, reverse=True):
        if len(p) > 2:
            text = F.regexp_replace(text, f"(?:\\Q{p}\\E){{2,}}", literal(p))
    return F.regexp_replace(text, r"(相关[^\s。，,；;]{1,8})(?:\1)+", "$1")


def sentence_fallback(text: Column, terms: Column, summary: Column | str) -> Column:
    """Sentences that hold a term (ignoring case) become the summary, with their end mark."""
    mark = summary if isinstance(summary, Column) else F.lit(summary)
    parts = F.regexp_extract_all(text, F.lit(r"(\n|[^。！？!?；;\n]+[。！？!?；;]?|[。！？!?；;])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda s: F.when((s != "\n") & F.exists(terms, lambda t: (t != "") & F.contains(F.lower(s), F.lower(t))), mark).otherwise(s)), "")


def hint(text: Column, line: str) -> Column:
    body = F.trim(text)
    return F.when(F.contains(body, F.lit(line)), body).when(body.endswith("。"), F.concat(body, F.lit(line))).otherwise(F.concat(body, F.lit("。" + line)))


def replacement_of(field: Column, replacements: dict[str, str]) -> Column:
    """The safe replacement of a field: the policy's, or the default one where the policy has none at all."""
    out = F.lit(REPLACEMENT)
    for name, value in (replacements or DEFAULTS).items():
        out = F.when(field == name, value).otherwise(out)
    return out


def is_safe(value: Column, field: Column, replacements: dict[str, str]) -> Column:
    """Empty values, known placeholders and the field's own replacement."""
    own = F.lit(False)
    for name, text in replacements.items():
        own = own | ((field == name) & (value == text))
    v = F.trim(F.coalesce(value, F.lit("")))
    return (v == "") | v.isin(PLACEHOLDERS) | own


def sensitive_fields(policy: Policy) -> list[str]:
    """The policy's own list, else its protected, identifier and display fields."""
    return policy.sensitive or list(dict.fromkeys([*policy.protected, *policy.identifiers, *([policy.display] if policy.display else [])]))


def dangerous(found: DataFrame, anchors: DataFrame, policy: Policy) -> DataFrame:
    """Output anchors to be redacted, one of each (turn, field, text): those of a finding of medium level or above that are
    sensitive or key to it. (turn_id, field_name, text, canonical, start, end, match_type)."""
    keys = found.filter(F.col("risk_level").isin("MEDIUM", "HIGH", "CRITICAL")).groupBy("turn_id").agg(F.array_distinct(F.flatten(F.collect_list("key_anchor_ids"))).alias("_keys"))
    out = anchors.filter((F.col("source") == "output") & ~F.col("inferred")).join(keys, "turn_id")
    kept = out.filter(F.col("protected") | F.col("field_name").isin(sensitive_fields(policy)) | F.array_contains("_keys", F.col("anchor_id")))
    safe = is_safe(F.col("text"), F.col("field_name"), policy.replacements) & is_safe(F.col("canonical"), F.col("field_name"), policy.replacements)
    return kept.filter(~safe).groupBy("turn_id", "field_name", "text").agg(F.min(F.struct("start", "end", "canonical", "match_type")).alias("a")).select("turn_id", "field_name", "text", "a.*")


def variants(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``terms``: the text and the canonical value of an anchor and the aliases of that value (field_name, canonical, term)."""
    own = F.array(F.col("text"), F.col("canonical"))
    if aliases is not None:
        told = aliases.groupBy("field_name", "canonical").agg(F.array_sort(F.collect_set("term")).alias("_aliases"))
        rows = rows.join(told, ["field_name", "canonical"], "left")
        own = F.concat(own, F.coalesce("_aliases", F.array().cast("array<string>")))
    return rows.withColumn("terms", F.array_distinct(F.filter(F.transform(own, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != ""))).drop("_aliases")


def apply_anchors(text: Column, anchors: Column, replacements: dict[str, str], x: bool = False) -> Column:
    """(text, unresolved): the anchors (field_name, text, start, end, match_type, terms), the longest first, replaced where
    their place still holds them and then in all their forms; where that changes nothing, the sentences that hold a form.

    A semantic anchor without a place and of which no form is in the text, or a form that no sentence gives up, leaves
    the text unresolved.
    """
    ordered = F.array_sort(anchors, lambda a, b: F.length(b["text"]) - F.length(a["text"]))
    kind = "struct<text:string,unresolved:boolean>"

    def step(acc, a):
        mark = F.lit("X") if x else replacement_of(a["field_name"], replacements)
        placed = F.when(a["start"] >= 0, span_replace(acc["text"], a["start"], a["end"], a["text"], mark)).otherwise(acc["text"])
        # A safe replacement has no pattern marks of its own.
        longest = F.array_sort(a["terms"], lambda p, q: F.length(q) - F.length(p))
        formed = F.aggregate(longest, placed, lambda t, term: F.regexp_replace(t, boundary_pattern(term), F.replace(F.replace(mark, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))))
        left = F.exists(a["terms"], lambda t: F.contains(F.lower(formed), F.lower(t)) & ~is_safe(t, a["field_name"], replacements))
        cut = sentence_fallback(formed, a["terms"], mark)
        same = formed == acc["text"]
        stuck = same & ((left & (cut == formed)) | (~left & (a["match_type"] == "semantic") & (a["start"] < 0)))
        return F.struct(F.when(same & left, cut).otherwise(formed).alias("text"), (acc["unresolved"] | stuck).alias("unresolved")).cast(kind)

    return F.aggregate(ordered, F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("unresolved")).cast(kind), step)


def summary(fields: Column, labels: dict[str, str]) -> Column:
    """The answer where redaction is uncertain: the labels of the fields concerned."""
    named = F.transform(fields, lambda f: F.coalesce(*[F.when(f == k, F.lit(v)) for k, v in labels.items()], f))
    return F.when(F.size(named) > 0, F.concat(F.lit("该回答涉及可能导致受限事实恢复的字段信息（"), F.array_join(named, "、"), F.lit("），具体内容已省略。"))).otherwise("该回答涉及可能导致受限事实恢复的信息，具体内容已省略。")


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered pattern rewrites of known cases; replacements are taken as they stand."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, literal(replacement))
    return text


def redact_names(text: Column, names: Column, mark: str) -> Column:
    """The names of target facts, each as a literal; safe placeholders stay."""
    kept = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: (F.coalesce(F.trim(n), F.lit("")) != "") & ~F.trim(n).isin(PLACEHOLDERS))
    return F.aggregate(kept, text, lambda t, n: F.regexp_replace(t, boundary_pattern(F.trim(n)), F.lit(literal(mark))))


def safe_answers(turns: DataFrame, found: DataFrame, anchors: DataFrame, policy: Policy, aliases: DataFrame | None = None, cases: list[tuple[str, str]] = (), x_cases: list[tuple[str, str]] = (), key: str = "turn_id", answer: str = "model_output") -> DataFrame:
    """(turn_id, x_replaced, safe_answer, unresolved) of every turn.

    A turn without findings keeps its answer but for bare ids. With findings the dangerous anchors are replaced (by X, or
    by the safe replacements), then target names where the display field is sensitive, then ids; the safe answer is
    also swept by the policy's patterns and its repeated placeholders collapse. An unresolved text becomes X or the
    summary of its fields, and the hint is added once.
    """
    bad = variants(dangerous(found, anchors, policy), aliases).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "text", "start", "end", "match_type", "terms"))).alias("_anchors"))
    about = found.groupBy("turn_id").agg(F.array_sort(F.collect_set("target_name")).alias("_names"), F.array_distinct(F.flatten(F.collect_list("restored_fields"))).alias("_fields"), F.lit(True).alias("_found"))
    own = anchors.filter((F.col("source") == "output") & ~F.col("inferred")).groupBy("turn_id").agg(F.array_sort(F.collect_set("field_name")).alias("_own"))
    rows = turns.select(F.col(key).alias("turn_id"), F.coalesce(answer, F.lit("")).alias("_raw")).join(bad, "turn_id", "left").join(about, "turn_id", "left").join(own, "turn_id", "left")
    held = F.coalesce("_anchors", F.array().cast("array<struct<field_name:string,text:string,start:int,end:int,match_type:string,terms:array<string>>>"))
    rows = rows.withColumn("_x", apply_anchors(rewrite(F.col("_raw"), list(x_cases)), held, policy.replacements, True)).withColumn("_s", apply_anchors(rewrite(F.col("_raw"), list(cases)), held, policy.replacements))
    show = policy.display in sensitive_fields(policy)
    mark = policy.replacements.get(policy.display, REPLACEMENT)
    x, s = mask_ids(F.col("_x.text")), mask_ids(F.col("_s.text"))
    if show:
        x, s = redact_names(x, F.col("_names"), "X"), redact_names(s, F.col("_names"), mark)
    swept = {f: policy.replacements.get(f, REPLACEMENT) for f in policy.protected}
    s = collapse(sweep(s, swept), list(policy.replacements.values()))
    line = policy.hint or HINT
    fields = F.array_distinct(F.concat(F.coalesce("_fields", F.array().cast("array<string>")), F.coalesce("_own", F.array().cast("array<string>"))))
    quiet = mask_ids(F.col("_raw"))
    return rows.select(
        "turn_id", F.when(F.col("_found"), hint(F.when(F.col("_x.unresolved"), "X").otherwise(x), line)).otherwise(quiet).alias("x_replaced"),
        F.when(F.col("_found"), hint(F.when(F.col("_s.unresolved"), summary(fields, policy.labels)).otherwise(s), line)).otherwise(quiet).alias("safe_answer"),
        F.coalesce(F.col("_s.unresolved"), F.lit(False)).alias("unresolved"),
    )


def hide_new_names(turns: DataFrame, names: DataFrame, policy: Policy, key: str = "turn_id", question: str = "user_input", answer: str = "safe_answer") -> DataFrame:
    """The answers without display values (``names``: value) of two characters or more that the question does not state, where the
    policy lists the display field as sensitive. Values meet the answers by containment."""
    if policy.display not in policy.sensitive:
        return turns
    mark = policy.replacements.get(policy.display, REPLACEMENT)
    hits = contains_join(turns.select(key, F.coalesce(answer, F.lit("")).alias("text"), F.coalesce(question, F.lit("")).alias("_asked")), names.select(F.col("value").alias("term")).filter("length(term) >= 2").distinct())
    new = hits.filter(F.contains("text", F.col("term")) & ~F.contains("_asked", F.col("term"))).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("_new"))
    told = F.aggregate(F.coalesce("_new", F.array().cast("array<string>")), F.col(answer), lambda t, n: F.replace(t, n, F.lit(mark)))
    return turns.join(new, key, "left").withColumn(answer, told).drop("_new")


def recheck(text: Column, terms: Column, fields: dict[str, str], fallback: str) -> Column:
    """Redacted text; swept where a term is left, and the fallback where even that leaves one."""
    left = lambda t: F.exists(terms, lambda x: (x != "") & F.contains(F.lower(t), F.lower(x)))
    once = fold(text, terms)
    twice = sweep(once, fields)
    return F.when(~left(once), once).when(~left(twice), twice).otherwise(fallback)


def recheck_answers(answers: DataFrame, vocabulary: DataFrame, policy: Policy, key: str = "turn_id", answer: str = "safe_answer", extract=None) -> DataFrame:
    """Answers extracted anew: where protected values are left, the sweep; where they still are, the labels of their fields.

    ``extract`` gives the anchors (turn_id, source, field_name, protected, inferred) of (turn_id, source, text); by
    default the literal ones of the vocabulary.
    """
    from . import analyze

    find = extract or (lambda parts: analyze.extract(parts, vocabulary, policy))

    def left(rows: DataFrame, column: str) -> DataFrame:
        parts = rows.select(F.col(key).alias("turn_id"), F.lit("output").alias("source"), F.col(column).alias("text"))
        return find(parts).filter("protected and not inferred").groupBy(F.col("turn_id").alias(key)).agg(F.array_sort(F.collect_set("field_name")).alias("_left"))

    once = answers.join(left(answers, answer), key, "left")
    swept = once.withColumn("_swept", F.when(F.col("_left").isNull(), F.col(answer)).otherwise(sweep(F.col(answer), {f: policy.replacements.get(f, REPLACEMENT) for f in policy.protected}))).drop("_left")
    again = swept.join(left(swept, "_swept"), key, "left")
    named = F.transform("_left", lambda f: F.coalesce(*[F.when(f == k, F.lit(v)) for k, v in policy.labels.items()], f))
    last = F.concat(F.lit("该回答涉及受限信息（"), F.array_join(named, "、"), F.lit("），具体内容已省略。" + policy.hint))
    return again.withColumn(answer, F.when(F.col("_left").isNull(), F.col("_swept")).otherwise(last)).drop("_left", "_swept")


def demo(text: Column, hits: Column) -> Column:
    """The answer with the sentences that hold a hit (also without its white space) replaced, the longest hit first."""
    ordered = F.array_sort(F.filter(F.coalesce(hits, F.array().cast("array<string>")), lambda h: h != ""), lambda a, b: F.length(b) - F.length(a))
    both = F.flatten(F.transform(ordered, lambda h: F.array_distinct(F.filter(F.array(h, F.regexp_replace(h, r"(?U)\s+", "")), lambda x: x != ""))))
    return F.aggregate(both, F.coalesce(text, F.lit("")), lambda t, h: F.regexp_replace(t, F.concat(F.lit(f"{SENTENCE}*"), escape_regex(h), F.lit(f"{SENTENCE}*")), F.lit(literal(DEMO_MARK))))


def second_rewrite(rewritten: Column, risky: Column) -> Column:
    """A generator's rewrite, or the fallback where there is none or it was found risky again."""
    body = F.trim(F.coalesce(rewritten, F.lit("")))
    return F.when((body == "") | F.coalesce(risky, F.lit(True)), FALLBACK).otherwise(body)


# Words that follow the first two parts of a version.
FAMILY = r"(?:{0}\s*系列中受影响的小版本|{0}\s*分支中的受影响版本|(?<![A-Za-z0-9_.\-]){0}\s*(?:系列|分支|版本线|小版本|受影响版本|相关版本)(?![A-Za-z0-9_.\-]))"


def fuzz_version(text: Column, term: Column, replacement: str = "X") -> Column:
    """Replaces a term with a version in the forms it is usually cited in, the most specific first.

    Product and version (any separator, an optional v), the family of the first two parts with a word such as 系列,
    the bare version, and the literal. A term without a version is replaced literally; null stays null.
    """
    edge, safe = r"[A-Za-z0-9_.\-]", replacement.replace("\\", "\\\\").replace("$", "\\$")
    version = F.regexp_extract(term, r"\d+(?:\.\d+){1,3}", 0)
    product = F.regexp_replace(F.regexp_extract(term, r"(?s)^(.*?)\d+(?:\.\d+){1,3}", 1), r"^[ \-_:/，,;；]+|[ \-_:/，,;；]+$", "")
    body = F.regexp_replace(F.regexp_replace(escape_regex(product), "-", r"[\\s_\\-]*"), " ", r"[\\s_\\-]+")
    number, family = escape_regex(version), escape_regex(F.regexp_extract(version, r"^\d+\.\d+", 0))
    cited = F.concat(F.lit(rf"(?i)(?<!{edge})"), body, F.lit(r"\s*[\-_:]?\s*v?\s*"), number, F.lit(rf"(?!{edge})"))
    bare = F.concat(F.lit(rf"(?i)(?<!{edge})v?\s*"), number, F.lit(rf"(?!{edge})"))
    families = F.replace(F.lit("(?i)" + FAMILY.replace("{0}", "@@")), F.lit("@@"), family)
    out = F.when(product != "", F.regexp_replace(text, cited, F.lit(safe))).otherwise(text)
    out = F.regexp_replace(F.regexp_replace(out, families, F.lit(safe)), bare, F.lit(safe))
    return F.regexp_replace(F.when(version != "", out).otherwise(text), boundary_pattern(term), F.lit(safe))
