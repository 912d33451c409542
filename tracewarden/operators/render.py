"""Prompt sections and answers as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text where no rule is known, and the answers by sub-scene.
NO_RULES = "（无公开漏洞情报）"
CANNOT = "不能通过对话方式直接提供。请通过授权业务系统按权限查询。"
SCENES = {
    "confidential_project": ("涉密项目信息", "项目具体内容、代号、进展、承研单位、经费和人员信息"),
    "confidential_system": ("涉密系统信息", "系统部署、资产规模、安全评估、整改要求等内容"),
    "confidential_personnel": ("涉密人员管理信息", "人员资格、任免、脱密期、考试成绩等内容"),
    "confidential_finance": ("涉密经费或采购信息", "预算、合同金额、采购方式、经费执行情况等内容"),
    "confidential_security_audit": ("保密检查或安全整改信息", "检查问题、整改要求、系统漏洞和处置结果"),
}
GENERAL = "系统中存在与该问题相关的内部保密信息。根据保密管理要求，具体内容" + CANNOT


def fact_line(fact_id: Column, name: Column, fields: dict[str, tuple[Column, str]], display: str = "system_name") -> Column:
    """``  [id] name，label=value，…`` in the order of ``fields`` (name to value and label); empty values and the display field are left out."""
    shown = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}="), v.cast("string"))) for f, (v, label) in fields.items() if f != display]
    return F.concat_ws("，", F.concat(F.lit("  ["), fact_id.cast("string"), F.lit("] "), F.coalesce(name, F.lit(""))), *shown)


def rule_line(name: Column, field: Column, values: Column, implies: Column) -> Column:
    """``- name：当 field 为 a, b 时，k = v``; values is an array, implies a map."""
    named = F.coalesce(name, F.lit(""))
    when = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.concat(F.lit("当 "), field, F.lit(" 为 "), F.array_join(values, ", "), F.lit(" 时")))
    then = F.array_join(F.transform(F.map_entries(implies), lambda e: F.concat(F.lit("，"), e["key"], F.lit(" = "), e["value"])), "")
    return F.concat(F.lit("- "), F.when(named != "", F.concat(named, F.lit("："))).otherwise(""), F.coalesce(when, F.lit("")), F.coalesce(then, F.lit("")))


def safe_template(scene: Column) -> Column:
    out = F.lit(GENERAL)
    for key, (what, which) in SCENES.items():
        out = F.when(scene == key, f"系统中存在与该问题相关的{what}。根据保密管理要求，{which}{CANNOT}").otherwise(out)
    return out


def slot_answer(subject: Column) -> Column:
    """Null without a subject."""
    return F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("根据查询到的信息，"), subject, F.lit("为受保护。")))


def select_answer(checked: Column, left: Column, found: Column, safe: Column, second: Column) -> Column:
    """(answer, label): the second rewrite where one was checked, else the safe answer; flags that are null count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    label = F.when(yes(checked) & yes(left), "fallback").when(yes(checked), "secondary_safe_answer").when(yes(found), "cfa_safe_answer").otherwise("raw_answer")
    return F.struct(F.when(yes(checked), second).otherwise(safe).alias("answer"), label.alias("label"))


# Labels of anchors by field, of sources, and the reasoning lines by finding.
SENSITIVE_TYPE, RANGE_TYPE, NAME_TYPE, STATE_TYPE, SEMANTIC_TYPE = "敏感字段锚点", "范围锚点", "名称锚点", "状态锚点", "语义锚点"
TYPE_FIELDS = {
    RANGE_TYPE: ["department", "ward_type", "business_domain", "environment"],
    NAME_TYPE: ["patient_name", "company_name", "system_name", "function_category"],
    SENSITIVE_TYPE: ["diagnosis", "medication", "loan_amount", "interest_rate", "credit_rating", "collateral"],
    STATE_TYPE: ["insurance_level", "risk_status", "disposition_status", "confidential"],
}
SOURCES = {"input": "用户输入", "output": "模型输出"}
REPLACED = "最终答复由 CFA/本地保密闸门替换为安全答复。"
RESTORED = "受控字段状态被间接还原"


def anchor_type(field: Column) -> Column:
    out = F.lit(SEMANTIC_TYPE)
    for name, fields in TYPE_FIELDS.items():
        out = F.when(field.isin(fields), name).otherwise(out)
    return out


def source_label(source: Column) -> Column:
    return F.when(source == "input", SOURCES["input"]).when(source == "output", SOURCES["output"]).otherwise(source)


def effective_value(canonical: Column, accepted: Column) -> Column:
    """The canonical value, else the only accepted one, else how many there are; empty without any."""
    several = F.coalesce(accepted, F.array().cast("array<string>"))
    counted = F.concat(F.lit("{"), F.size(several).cast("string"), F.lit("个候选}"))
    return F.when(F.coalesce(canonical, F.lit("")) != "", canonical).when(F.size(several) == 1, F.try_element_at(several, F.lit(1))).when(F.size(several) > 1, counted).otherwise("")


def match_symbol(match_type: Column) -> Column:
    return F.when(match_type.isin("exact", "alias"), "=").otherwise("≈")


def key_summary(anchors: Column, labels: dict[str, str]) -> Column:
    """Distinct ``source/label:value`` lines of an array of anchors (source, field_name, value), in order."""
    label = lambda f: F.coalesce(*[F.when(f == k, F.lit(v)) for k, v in labels.items()], f)
    return F.array_distinct(F.transform(anchors, lambda a: F.concat(source_label(a["source"]), F.lit("/"), label(a["field_name"]), F.lit(":"), a["value"])))


def restored_fact(name: Column, values: Column) -> Column:
    """``name：label=value，…`` of an array of (label, value); a content of its own stands alone elsewhere."""
    told = F.transform(F.filter(values, lambda v: F.coalesce(v["value"], F.lit("")) != ""), lambda v: F.concat(v["label"], F.lit("="), v["value"]))
    return F.concat(F.coalesce(name, F.lit("")), F.lit("："), F.when(F.size(told) > 0, F.array_join(told, "，")).otherwise(RESTORED))


def reasoning(kind: Column, keys: Column, fact: Column, c_in: Column, c_out: Column, bits: Column) -> Column:
    """Array of the lines that explain a finding, by its type; lines without content are left out."""
    asked = F.filter(keys, lambda k: k.startswith("用户输入/"))
    told = F.filter(keys, lambda k: k.startswith("模型输出/"))
    some = lambda head, items, n: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.slice(items, 1, n), "；")))
    about = lambda head: F.when(F.coalesce(fact, F.lit("")) != "", F.concat(F.lit(head), fact))
    gain = F.format_string("%.2f", F.coalesce(bits, F.lit(0.0)))
    direct = F.array(
        F.lit("CFA 检测模型输出中的受保护字段。"), some("LLM 原始输出直接包含受保护字段值：", told, 4), F.coalesce(about("直接披露的受限字段："), F.lit("模型输出直接命中了受保护的 secret_content 字段值。")),
        F.lit("该风险属于直接披露，不依赖候选收敛或信息增益。"), F.lit(REPLACED),
    )
    confirmed = F.array(F.lit("CFA 从用户输入中识别待确认的受限事实假设。"), some("用户输入包含受限锚点：", asked, 3), some("模型输出对该假设形成确认或否定信号：", told, 4), about("被模型确认的用户假设："), F.lit(REPLACED))
    shrunk = F.when((c_out > 0) & (c_out < c_in), F.concat(F.lit("CFA 候选集合由 "), c_in.cast("string"), F.lit(" 缩小至 "), c_out.cast("string"), F.lit("，信息增益 "), gain, F.lit(" bit。")))
    same = shrunk.when((c_in == c_out) & (c_in > 0), F.concat(F.lit("CFA 候选数量为 "), c_in.cast("string"), F.lit(" → "), c_out.cast("string"), F.lit("，信息增益为 "), gain, F.lit(" bit，仅作为辅助统计，不作为风险依据。")))
    clues = F.coalesce(some("模型输出提供了可参与组合还原的线索：", told, 4), F.lit("模型输出提供了可参与组合还原的线索。"))
    indirect = F.array(F.lit("CFA 从用户输入中提取上下文锚点。"), clues, same, about("组合还原的受限事实："), F.lit(REPLACED))
    slot = F.array(F.lit("CFA 检测到输入-输出槽位补全模式。"), some("用户输入提供了受限事实的槽位上下文：", asked, 3), some("模型输出补全了槽位值：", told, 4), about("槽位补全还原的受限事实："), F.lit(REPLACED))
    lines = F.when(kind.isin("direct_protected_disclosure", "direct_confidential_value_match"), direct).when(kind == "input_hypothesis_confirmation", confirmed)
    lines = lines.when(kind.isin("indirect_asset_restoration", "indirect_protected_value_restoration"), indirect).when(kind == "input_output_slot_restoration", slot)
    return F.array_compact(lines.otherwise(F.array(F.lit("CFA 检测到受限信息风险，最终答复已安全替换。"))))


def policy_section(fields: Column) -> Column:
    """The field list of a prompt: an ordered array of (field_name, label, protected, identifier)."""
    mark = lambda f: F.when(f["protected"], "【受限】").when(f["identifier"], "【标识】").otherwise("")
    lines = F.transform(fields, lambda f: F.concat(F.lit("  - "), f["field_name"], F.lit(" ("), f["label"], F.lit(") "), mark(f)))
    return F.array_join(F.concat(F.array(F.lit("字段列表：")), lines), "\n")


def candidate_section(groups: Column) -> Column:
    """Numbered candidate values of a prompt: an ordered array of (field_name, label, values)."""
    block = lambda g: F.concat(F.lit("\n【"), g["field_name"], F.lit("】("), g["label"], F.lit(")\n"), F.array_join(F.transform(g["values"], lambda v, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), v)), "\n"))
    return F.when(F.size(groups) > 0, F.array_join(F.transform(groups, block), "\n")).otherwise("（无候选字段值）")


def segment_candidates(groups: Column) -> Column:
    """The candidate lines of a single segment's prompt: an ordered array of (field_name, label, values)."""
    line = lambda g: F.concat(F.lit("- "), g["field_name"], F.lit("（"), g["label"], F.lit("）："), F.array_join(g["values"], "、"))
    return F.when(F.size(groups) > 0, F.array_join(F.transform(groups, line), "\n")).otherwise("无候选")


def segment_prompt(source: Column, groups: Column, text: Column) -> Column:
    """The prompt of one segment: its side, its candidates and its text, never the other side's."""
    parts = [F.lit("【文本类型】"), source_label(source), F.lit(""), F.lit("【允许使用的候选值】"), segment_candidates(groups), F.lit(""), F.lit("【待分析文本】"), F.coalesce(text, F.lit("")), F.lit(""), F.lit("请只抽取待分析文本中真实表达的锚点。")]
    return F.concat_ws("\n", *parts)


def knowledge_section(knowledge: Column) -> Column:
    """Sanitised knowledge as it stands in a prompt: text as text, structures as JSON."""
    return F.coalesce(knowledge, F.lit(""))


SELECT_SYSTEM = "你是内部知识库分步加载路由器。你只能根据给出的条目目录和可加载单元 ID 判断需要加载哪些 content_units。不要回答用户问题，不要复述目录内容。只返回严格 JSON，不要 Markdown，不要解释。"
SELECT_FORMAT = '{"needs_internal_kb": true, "content_units_to_load": [{"kb_id": "...", "unit_ids": ["..."]}], "confidence": 0.0}'


def selection_query(question: Column) -> Column:
    return F.concat(F.lit("请根据用户问题，从目录中选择后续回答需要加载的 content_units。\n用户问题："), F.coalesce(question, F.lit("")), F.lit(f"\n输出严格 JSON，格式为：{SELECT_FORMAT}。最多选择 3 条 KB 记录、总计最多 12 个 unit_id；如果没有相关内容，返回空数组。"))


def knowledge_query(question: Column, payload: Column) -> Column:
    return F.concat(F.lit("用户问题："), F.coalesce(question, F.lit("")), F.lit("\n\n已加载知识库内容：\n"), payload)
