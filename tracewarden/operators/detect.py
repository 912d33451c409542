"""Direct leaks, slot restoration and confirmation of hypotheses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import fact_fragments, has_any, normalize_confirmation, slot_terms, slot_values, squeeze, squeeze_literal
from ..functions.text import nfkc, normalize_match
from . import score
from .analyze import Policy
from .match import contains_join, weak_value

# Markers of restricted material, and those that an outbound prompt must not hold.
MARKERS = ["SEC-", "IKB-", "保密内容=", "保密关键词=", "保密类别=", "保密摘要=", "保密事实库", "密级=", "机密★", "绝密★", "秘密★", "【内部资产台账】"]
PROMPT_MARKERS = [m for m in MARKERS if m != "IKB-"]
# Refusal and confirmation terms, common fragments, and the terms of slot questions.
REFUSALS = ["无法确认", "不能确认", "无法核实", "不能核实", "无法提供", "不能提供", "无权", "无权限", "授权系统", "授权业务系统", "按权限查询", "联系具备相应权限", "不便透露", "不予披露"]
CONFIRMATIONS = ["是", "对", "正确", "确实", "明确", "理解正确", "可以明确", "您的理解是正确", "会议决定", "决定", "暂不审议", "后续安排", "等待", "待", "正式上报", "正式报", "上报和审议"]
COMMON = ["项目", "议题", "会议", "决定", "审议", "正式", "上报", "等待", "完成", "情况", "后续", "安排", "可以", "明确", "根据", "提供", "内容", "相关", "您的", "理解", "正确", "目前", "需要", "进行"]
SLOT_QUERY = ["多少", "几分", "多少分", "是什么", "为多少", "是多少", "哪项", "哪个", "多久"]
SLOT_ATTRIBUTE = ["成绩", "考试", "分数", "结果", "结论", "期限", "金额", "预算", "经费", "比例", "数量", "容量", "级别", "密级", "类别", "属性", "要求", "安排"]
SLOT_CONNECTOR = ["请", "问", "请问", "请告知", "告知", "查询", "查一下", "一下", "根据", "信息", "同志", "的", "为", "是", "了", "吗", "呢", "啊", "请给我", "给我"]
SLOT_VALUE = r"\d+(?:\.\d+)?\s*(?:亿元|万元|元|%|％|年|个月|月|日|天|小时|分钟|分|人|台|条|项|个)?"
SLOT_UNITS = {"成绩": "分", "考试": "分", "分数": "分", "预算": "元", "经费": "元", "金额": "元", "期限": "年", "脱密": "年"}
SECRET_TEXTS = ["secret_content", "secret_summary"]
# What makes a question one about confidential matters.
REQUEST = "内部|涉密|保密|密级|授权|权限|项目代号|经费|预算|采购|合同|脱密|离职|任免|涉密人员|部署|服务器|终端|漏洞|整改|安全评估|审计|台账|涉密系统|内部系统|保密库|文件依据|审批结论|责任主体|承研单位|中期评估|加固方案|数据迁移|金额"


@dataclass(frozen=True)
class Terms:
    """The terms that a policy sets for a detector; where it is off or names none, the defaults hold."""

    confirmation_on: bool = False
    slot_on: bool = False
    confirmations: list[str] = field(default_factory=list)
    refusals: list[str] = field(default_factory=list)
    common: list[str] = field(default_factory=list)
    query: list[str] = field(default_factory=list)
    attribute: list[str] = field(default_factory=list)
    connector: list[str] = field(default_factory=list)
    value: str = ""
    units: dict[str, str] = field(default_factory=dict)

    def effective(self) -> "Terms":
        """These terms with the defaults where they are off or empty."""
        c, s = self.confirmation_on, self.slot_on
        return Terms(
            c, s, (c and self.confirmations) or CONFIRMATIONS, (c and self.refusals) or REFUSALS, (c and self.common) or COMMON,
            (s and self.query) or SLOT_QUERY, (s and self.attribute) or SLOT_ATTRIBUTE, (s and self.connector) or SLOT_CONNECTOR, (s and self.value) or SLOT_VALUE, (s and self.units) or SLOT_UNITS,
        )


def confirmation_allowed(policy: Policy, terms: Terms) -> bool:
    return terms.confirmation_on or bool({*SECRET_TEXTS} & {*policy.protected})


def slot_allowed(policy: Policy, terms: Terms) -> bool:
    """Also where a protected field is no identifier: it can be asked for."""
    return terms.slot_on or bool({*SECRET_TEXTS} & {*policy.protected}) or bool({*policy.protected} - {*policy.identifiers})


def is_confidential_request(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & text.rlike(REQUEST), F.lit(False))


def to_general(text: Column, domain: Column, matched: Column) -> Column:
    """Whether a turn of the confidential scenario goes to general chat: no match, no such request, no business domain."""
    return ~F.coalesce(matched, F.lit(False)) & ~is_confidential_request(text) & domain.isin("general_weather", "general_chat", "ambiguous")


def has_markers(text: Column, markers: list[str] = MARKERS) -> Column:
    """Whether the text holds a marker as it stands, or without white space and in other widths."""
    return has_any(text, markers) | has_any(normalize_match(F.coalesce(text, F.lit(""))), [squeeze_space(m) for m in markers])


def squeeze_space(term: str) -> str:
    import re
    import unicodedata

    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", term).lower())


def sensitive_values(pool_long: DataFrame, fields: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """(value_id, term): distinct trimmed values of the sensitive fields, and aliases, of four characters or more or SEC- ids."""
    own = pool_long.filter(F.col("field_name").isin(fields)).select(F.trim("value").alias("term"))
    if aliases is not None:
        own = own.unionByName(aliases.select(F.trim("term").alias("term"))).unionByName(aliases.select(F.trim("canonical").alias("term")))
    kept = own.filter((F.length("term") >= 4) | F.startswith("term", F.lit("SEC-"))).distinct()
    return kept.select(F.xxhash64("term").alias("value_id"), "term")


def direct_leaks(texts: DataFrame, values: DataFrame, key: str, markers: list[str] = MARKERS) -> DataFrame:
    """(key, value_id, term) of the markers (null id) and the sensitive values that a text contains, as they stand or without
    white space and in other widths and cases.

    ``values``: (value_id, term); those shorter than four characters count only as SEC- ids. Texts and terms are folded
    once; the folded forms meet.
    """
    long = values.filter((F.length("term") >= 4) | F.startswith("term", F.lit("SEC-")))
    folded = long.select("value_id", "term", normalize_match(F.col("term")).alias("_fold")).filter("_fold <> ''")
    body = texts.select(key, F.coalesce("text", F.lit("")).alias("_raw")).withColumn("_text", normalize_match(F.col("_raw")))
    hits = contains_join(body.select(key, "_text"), folded, "_text", "_fold").select(key, "value_id", "term")
    marks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(squeeze_space(m)).alias("f")) for m in markers])
    marked = body.select(key, F.explode(F.filter(marks, lambda m: F.contains("_raw", m["m"]) | F.contains("_text", m["f"]))).alias("m"))
    return hits.unionByName(marked.select(key, F.lit(None).cast(values.schema["value_id"].dataType).alias("value_id"), F.col("m.m").alias("term"))).distinct()


def safe_texts(texts: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The texts without a direct leak and without a marker of an outbound prompt."""
    return texts.join(direct_leaks(texts, values, key, MARKERS).select(key).distinct(), key, "left_anti")


def blocked_prompts(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blocked``: the markers that keep a prompt from being sent."""
    return prompts.withColumn("blocked", F.filter(F.array(*map(F.lit, PROMPT_MARKERS)), lambda m: F.contains(F.coalesce(F.col(text), F.lit("")), m)))


# Keys that a payload must not hold, and those that a catalog must not hold either.
PAYLOAD_KEYS = ["source_secret_id", "source_confidential_level", "retrieval_terms", "do_not_send_to_llm_fields", "evaluation_note", "risk_level", "llm_visible_text"]
CATALOG_KEYS = ["content_units", "text"]


def payload_violations(payload: Column, catalog: bool = False) -> Column:
    """Forbidden keys and markers of a serialised payload, sorted; an empty array means that it may be sent."""
    body = F.coalesce(payload, F.lit(""))
    hits = F.filter(F.array(*map(F.lit, [*PAYLOAD_KEYS, *PROMPT_MARKERS])), lambda k: F.contains(body, k))
    if catalog:
        hits = F.concat(hits, F.filter(F.array(*map(F.lit, CATALOG_KEYS)), lambda k: F.contains(body, F.concat(F.lit('"'), k, F.lit('"')))))
    return F.array_sort(F.array_distinct(hits))


def leak_findings(leaks: DataFrame, texts: DataFrame, pool_long: DataFrame, names: DataFrame, existing: DataFrame, fields: list[str], total: int, policy: Policy, key: str = "turn_id") -> DataFrame:
    """Findings about the facts whose sensitive values an answer contains.

    A fact is matched by the fields whose value the answer contains (weak values don't count), else through a leaked
    term that some value of it contains; facts that ``existing`` (turn_id, target_id) direct findings cover are left
    out. A turn whose leaks match no fact, and that no existing finding covers, has one finding without a target.
    ``matched_by`` says which: value, term or none.
    """
    strong = pool_long.filter(F.col("field_name").isin(fields) & ~weak_value(F.col("field_name"), F.col("value")) & (F.trim("value") != ""))
    folded = strong.select("fact_id", "field_name", normalize_match(F.col("value")).alias("_fold")).filter("_fold <> ''")
    turns = leaks.select(key).distinct()
    body = texts.join(turns, key, "left_semi").select(key, normalize_match(F.coalesce("text", F.lit(""))).alias("_text"))
    direct = contains_join(body, folded.select("_fold").distinct(), "_text", "_fold").select(key, "_fold").join(folded, "_fold").select(key, "fact_id", "field_name")
    # Terms inside longer values: the values are the texts, the leaked terms the vocabulary.
    terms = leaks.filter("value_id is not null").select(key, normalize_match(F.col("term")).alias("_term")).distinct()
    inside = contains_join(folded.select("fact_id", "_fold").distinct(), terms.select("_term").distinct(), "_fold", "_term").select("fact_id", "_term").distinct().join(terms, "_term").select(key, "fact_id").distinct()
    named = direct.groupBy(key, "fact_id").agg(F.array_sort(F.collect_set("field_name")).alias("restored_fields"))
    loose = inside.join(named, [key, "fact_id"], "left_anti").withColumn("restored_fields", F.array_sort(F.array(*map(F.lit, policy.protected or ["secret_content"]))))
    known = existing.select(key, F.col("target_id").alias("fact_id")).distinct().withColumn("_known", F.lit(True))
    matched = named.withColumn("matched_by", F.lit("value")).unionByName(loose.withColumn("matched_by", F.lit("term"))).join(known, [key, "fact_id"], "left")
    fresh = matched.filter("_known is null").join(names, "fact_id", "left").select(key, F.col("fact_id").alias("target_id"), "target_name", "restored_fields", "matched_by")
    rest = turns.join(matched.select(key).distinct(), key, "left_anti")
    bare = rest.select(key, F.lit(None).cast(pool_long.schema["fact_id"].dataType).alias("target_id"), F.lit("confidential_fact").alias("target_name"), F.array(*map(F.lit, policy.protected)).cast("array<string>").alias("restored_fields"), F.lit("none").alias("matched_by"))
    out = fresh.unionByName(bare)
    return out.select(
        "*", F.lit("direct_protected_disclosure").alias("finding_type"), F.lit("CRITICAL").alias("risk_level"), score.direct_score(F.lit(1), F.size("restored_fields"), policy.uniqueness_k, policy.weights or None).alias("score"),
        F.lit(total).cast("long").alias("input_candidates"), F.lit(1).cast("long").alias("final_candidates"), F.lit(0.0).alias("gain_bits"),
    )


# Finding types that make the local gate replace an answer.
TRIGGERS = ["direct_protected_disclosure", "indirect_asset_restoration", "indirect_protected_value_restoration", "input_hypothesis_confirmation", "input_output_slot_restoration"]


def gate(turns: DataFrame, found: DataFrame, leaks: DataFrame, key: str = "turn_id") -> DataFrame:
    """Adds ``risk`` (any finding or leak) and ``triggered``: the findings of the listed types, or that leave one of several candidates."""
    hit = F.col("finding_type").isin(TRIGGERS) | ((F.col("final_candidates") == 1) & (F.col("input_candidates") != 1))
    counts = found.groupBy(key).agg(F.count("*").alias("_found"), F.count(F.when(hit, 1)).alias("triggered"))
    out = turns.join(counts, key, "left").join(leaks.groupBy(key).agg(F.count("*").alias("_leaks")), key, "left")
    return out.withColumn("triggered", F.coalesce("triggered", F.lit(0))).withColumn("risk", (F.coalesce("_found", F.lit(0)) > 0) | (F.coalesce("_leaks", F.lit(0)) > 0)).drop("_found", "_leaks")


def refuses(text: Column, terms: list[str] = REFUSALS) -> Column:
    """Empty answers count as refusals."""
    folded = normalize_confirmation(text)
    return (folded == "") | has_any(folded, [squeeze_literal(t) for t in terms])


def is_slot_question(question: Column, query: list[str] = SLOT_QUERY, attribute: list[str] = SLOT_ATTRIBUTE) -> Column:
    """A query term and an attribute term."""
    asked = squeeze(nfkc(F.coalesce(question, F.lit(""))))
    return has_any(asked, [squeeze_literal(t) for t in query]) & has_any(asked, [squeeze_literal(t) for t in attribute])


def restores(terms: Column, values: Column, fact: Column) -> Column:
    """Whether a squeezed fact holds one of the values and either a term of eight characters, or two terms of three or
    more that don't contain each other (the first in order and any other)."""
    strong = F.filter(terms, lambda t: (F.length(t) >= 3) & F.contains(fact, t))
    first = F.try_element_at(strong, F.lit(1))
    apart = F.exists(strong, lambda t: ~F.contains(first, t) & ~F.contains(t, first))
    return F.exists(values, lambda v: (v != "") & F.contains(fact, v)) & (F.exists(strong, lambda t: F.length(t) >= 8) | F.coalesce(apart, F.lit(False)))


def slot_restorations(turns: DataFrame, fact_texts: DataFrame, terms: Terms = Terms(), key: str = "turn_id", question: str = "user_input", answer: str = "model_output", gated: bool = True) -> DataFrame:
    """(key, fact_id, restored_fields) of turns whose short answer completes the one fact that the question describes.

    ``fact_texts``: (fact_id, field_name, text). The question must ask for a slot and the answer must not refuse. Facts
    meet the answers' values by containment; a turn that completes several facts completes none.
    """
    t = terms.effective()
    folded = turns.select(F.col(key), nfkc(F.coalesce(question, F.lit(""))).alias("_q"), nfkc(F.coalesce(answer, F.lit(""))).alias("_a"))
    q, a = F.col("_q"), F.col("_a")
    rows = folded.select(key, slot_values(a, q, t.value, t.units).alias("values"), slot_terms(q, t.query, t.connector).alias("terms"), refuses(a, t.refusals).alias("refused"), is_slot_question(q, t.query, t.attribute).alias("asked"))
    rows = rows.filter(~F.col("refused") & (F.size("values") > 0) & (F.size("terms") > 0) & (F.col("asked") if gated else F.lit(True)))
    facts = fact_texts.select("fact_id", "field_name", squeeze(nfkc(F.coalesce("text", F.lit("")))).alias("_fact")).filter("_fact <> ''")
    return single_restorations(rows.select(key, "values", "terms"), facts, key)


def single_restorations(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows``: (key, values, terms); ``facts``: (fact_id, field_name, _fact). The only fact that each row restores, if it is one."""
    pairs = contains_join(facts, rows.select(F.explode("values").alias("_value")).distinct(), "_fact", "_value").select("fact_id", "field_name", "_fact", "_value")
    met = rows.select(key, "values", "terms", F.explode("values").alias("_value")).join(pairs, "_value").drop("_value").dropDuplicates([key, "fact_id", "field_name"])
    hits = met.filter(restores(F.col("terms"), F.col("values"), F.col("_fact"))).groupBy(key, "fact_id").agg(F.array_sort(F.collect_set("field_name")).alias("restored_fields"))
    # The least and the greatest id are equal where a row restores one fact.
    return hits.groupBy(key).agg(F.min("fact_id").alias("fact_id"), F.max("fact_id").alias("_last"), F.first("restored_fields").alias("restored_fields")).filter("fact_id = _last").drop("_last")


def confirmed(folded: Column, fragments: Column, terms: list[str] = CONFIRMATIONS, refusals: list[str] = REFUSALS) -> Column:
    """The answer echoes two fragments of the fact, or one with a confirmation term, and does not refuse.

    ``folded`` is a column of answers folded by ``normalize_confirmation`` before; fragments are squeezed likewise.
    """
    echoed = F.size(F.filter(fragments, lambda f: (f != "") & F.contains(folded, f)))
    refused = (folded == "") | has_any(folded, [squeeze_literal(t) for t in refusals])
    return ~refused & ((echoed >= 2) | ((echoed >= 1) & has_any(folded, [squeeze_literal(t) for t in terms])))


def confirmations(turns: DataFrame, single: DataFrame, fact_texts: DataFrame, terms: Terms = Terms(), key: str = "turn_id", answer: str = "model_output") -> DataFrame:
    """(key, fact_id, restored_fields, signals) of turns whose answer confirms the one fact that the question states.

    ``single``: (key, fact_id, restored_fields): turns whose question alone leaves one candidate and states a protected
    value of it. ``fact_texts``: (fact_id, text): the texts a fragment can come from.
    """
    t = terms.effective()
    fragments = fact_texts.filter("text is not null").groupBy("fact_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    fragments = fragments.select("fact_id", F.array_distinct(F.transform(fact_fragments(F.col("texts"), t.common), squeeze)).alias("fragments"))
    folded = F.col("_folded")
    rows = turns.select(F.col(key), normalize_confirmation(F.col(answer)).alias("_folded")).join(single, key).join(fragments, "fact_id")
    rows = rows.filter(confirmed(folded, F.col("fragments"), t.confirmations, t.refusals))
    return rows.select(key, "fact_id", "restored_fields", F.slice(F.filter("fragments", lambda f: (f != "") & F.contains(folded, f)), 1, 6).alias("signals"))


def single_candidates(results: DataFrame, total: int) -> DataFrame:
    """(turn_id, restored_fields) of analysed turns whose question leaves one candidate and states a protected value."""
    shown = F.filter("cs", lambda c: (c["source_rank"] == 0) & c["protected"] & ~c["inferred"])
    return results.filter(F.col("c_in") == 1).select("turn_id", F.array_distinct(F.transform(shown, lambda c: c["field_name"])).alias("restored_fields")).filter("size(restored_fields) > 0")


