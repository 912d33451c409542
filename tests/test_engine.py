"""The engine's operators on small cases: splits, terms, gates, detectors, redaction, policies, scenarios, generators, traces."""

import json

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import llm_json, terms
from tracewarden.operators import analyze, claims, detect, kb, match, redact, render, respond, retrieve, route, score
from tracewarden.sources import convert, facts, ingest, policy, provider, resources, scenario, trace


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_claims_are_cut_at_list_marks_sentences_and_semicolons(spark):
    text = F.col("t")
    cut = lambda t: [(r.start, r.end, r.text) for r in one(spark, claims.split_claims(text), t=t)]
    assert cut("甲公司。乙公司；丙") == [(0, 3, "甲公司"), (4, 7, "乙公司"), (8, 9, "丙")]
    assert cut("一段话") == [(0, 3, "一段话")]
    assert [x[2] for x in cut("1. 甲\n2. 乙")] == ["1. 甲", "2. 乙"]
    spots = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("anchor_id")) for a, b in ((0, 2), (6, 8))])
    assert [r.text for r in one(spark, claims.refine_claims(text, spots), t="甲乙丙。丁；戊己庚，辛")] == ["甲乙丙。丁", "戊己庚，辛"]


def test_claim_builder_keeps_protected_segments_and_drops_repeats(spark):
    own = analyze.Policy(["company", "loan_amount"], protected=["loan_amount"], identifiers=["company"], quasi=["branch"])
    turns = spark.createDataFrame([(1, "甲公司", "贷款100万元；贷款200万元。无关。贷款100万元")], "turn_id long, user_input string, model_output string")
    vocab = spark.createDataFrame([("company", "甲公司", "甲公司", "exact"), ("loan_amount", "100万元", "100万元", "exact"), ("loan_amount", "200万元", "200万元", "exact")], "field_name string, canonical string, term string, match_type string")
    found = analyze.extract(analyze.segments(turns), vocab, own)
    made, held = claims.build(turns, found, vocab.select("field_name", F.col("canonical").alias("value")), own)
    # The cut is at the first semicolon near each value, so what follows it is one claim.
    assert sorted(r.signature for r in made.collect()) == ["loan_amount=100万元", "loan_amount=100万元|loan_amount=200万元"]
    assert held.count() == 3 and [r.canonical for r in claims.context(found, own).collect()] == ["甲公司"]
    assert claims.context_fields(own) == ["company", "branch"]


def test_merged_findings(spark):
    kind = "turn_id long, target_id long, finding_type string, restored_fields array<string>, ord int"
    found = spark.createDataFrame([(1, 7, "direct_protected_disclosure", ["a"], 0)], kind)
    more = spark.createDataFrame([(1, 7, "input_output_slot_restoration", ["a", "b"], 1), (1, 8, "input_output_slot_restoration", ["a"], 2), (1, 8, "input_output_slot_restoration", ["c"], 3), (1, 7, "input_hypothesis_confirmation", ["b"], 4)], kind)
    got = {(r.target_id, r.finding_type, tuple(r.restored_fields)) for r in claims.merge_findings(found, more).collect()}
    assert got == {(7, "direct_protected_disclosure", ("a",)), (8, "input_output_slot_restoration", ("a",)), (7, "input_hypothesis_confirmation", ("b",))}


def test_slot_and_fragment_terms(spark):
    frame = spark.createDataFrame([("请问张三考试成绩是多少？", "95")], "q string, a string")
    row = frame.select(terms.slot_terms(F.col("q"), detect.SLOT_QUERY, detect.SLOT_CONNECTOR).alias("t"), terms.slot_values(F.col("a"), F.col("q"), detect.SLOT_VALUE, detect.SLOT_UNITS).alias("v"), terms.slot_subject(F.col("q")).alias("s"), terms.slot_context(F.col("q"), detect.SLOT_QUERY).alias("c")).first()
    assert "张三考试成绩" in row.t and row.v == ["95", "95分"] and row.s == "张三考试成绩" and row.c == "张三考试成绩"
    fragments = one(spark, terms.fact_fragments(F.array(F.col("t")), ["项目"]), t="甲项目，完成立项审批")
    assert {"完成立项审批", "立项审批"} <= {*fragments} and "甲项目" not in fragments and [*map(len, fragments)] == sorted(map(len, fragments), reverse=True)
    assert one(spark, detect.is_slot_question(F.col("t")), t="成绩是多少") and not one(spark, detect.is_slot_question(F.col("t")), t="成绩")
    assert one(spark, detect.refuses(F.col("t")), t="无法提供。") and one(spark, detect.refuses(F.col("t")), t=" ")
    own = detect.Terms(confirmation_on=True, refusals=["不行"]).effective()
    assert own.refusals == ["不行"] and own.confirmations == detect.CONFIRMATIONS and own.query == detect.SLOT_QUERY
    plain = analyze.Policy(["a"], protected=["a"], identifiers=["a"])
    assert not detect.slot_allowed(plain, detect.Terms()) and detect.confirmation_allowed(analyze.Policy([], protected=["secret_summary"]), detect.Terms())


def test_gates_and_markers(spark):
    assert one(spark, detect.has_markers(F.col("t")), t="编号 ＳＥＣ－1") and not one(spark, detect.has_markers(F.col("t")), t="plain")
    assert one(spark, detect.is_confidential_request(F.col("t")), t="涉密项目代号") and not one(spark, detect.is_confidential_request(F.col("t")), t="hello")
    assert one(spark, detect.to_general(F.col("t"), F.lit("general_chat"), F.lit(False)), t="hello")
    turns = spark.createDataFrame([(1,), (2,), (3,)], "turn_id long")
    found = spark.createDataFrame([(1, "other", 1, 5), (2, "other", 1, 1)], "turn_id long, finding_type string, final_candidates int, input_candidates int")
    leaks = spark.createDataFrame([(3, None)], "turn_id long, value_id long")
    assert {r.turn_id: (r.risk, r.triggered) for r in detect.gate(turns, found, leaks).collect()} == {1: (True, 1), 2: (True, 0), 3: (True, 0)}


def test_leak_findings_fall_back_and_skip_known_ones(spark):
    own = analyze.Policy(["secret_content"], protected=["secret_content"])
    long = spark.createDataFrame([("F1", "secret_content", "甲方案 金额12.5亿元"), ("F2", "secret_content", "乙方案于周五启动")], "fact_id string, field_name string, value string")
    texts = spark.createDataFrame([(1, "内容：甲方案金额１２.5亿元"), (2, "乙方案于周五启动"), (3, "密级=高")], "turn_id long, text string")
    leaks = detect.direct_leaks(texts, detect.sensitive_values(long, ["secret_content"]), "turn_id")
    known = spark.createDataFrame([(2, "F2")], "turn_id long, target_id string")
    names = spark.createDataFrame([("F1", "甲"), ("F2", "乙")], "fact_id string, target_name string")
    got = {(r.turn_id, r.target_id, r.score) for r in detect.leak_findings(leaks, texts, long, names, known, ["secret_content"], 2, own).collect()}
    assert got == {(1, "F1", 90.0), (3, None, 90.0)}
    assert [r.turn_id for r in detect.safe_texts(spark.createDataFrame([(1, "SEC-1"), (2, "ok")], "turn_id long, text string"), detect.sensitive_values(long, ["secret_content"]), "turn_id").collect()] == [2]


def test_outcome_of_a_turn():
    own = analyze.Policy(["a", "b", "p"], protected=["p"])
    make = lambda side, name, value, start, protected=False: {"source_rank": side, "field_name": name, "value": value, "bound": "", "start": start, "end": start + 1, "inferred": False, "protected": protected, "weight": 1.0, "anchor_id": name}
    cs = [make(0, "a", "x", 0), make(1, "b", "y", 3)]
    got = analyze.outcome(cs, {1: (4, 1), 2: (2, 1), 3: (1, 1)}, {}, {}, 8, own)
    assert (got["c_in"], got["c_out"], got["gain_bits"], got["decision"], got["contributing"], got["combos"]) == (4, 1, 2.0, "indirect_asset_restoration", 2, [3])
    assert [(s["before"], s["after"]) for s in got["chain"]] == [(8, 4), (4, 1)]
    empty = analyze.outcome(cs, {1: (4, 1), 2: (2, 5), 3: (0, None)}, {}, {}, 8, own)
    assert empty["decision"] == "none" and empty["contributing"] == 0  # an output that empties the candidates is passed over
    shown = analyze.outcome([make(1, "p", "v", 0, True)], {1: (1, 9)}, {}, {}, 8, own)
    assert shown["decision"] == "direct_protected_disclosure" and shown["combos"] == [1] and shown["restored_fields"] == ["p"]
    value = analyze.outcome(cs, {1: (4, 1), 2: (3, 1), 3: (2, 1)}, {"p": (3, 1.5)}, {"p": (1, 0.0)}, 8, own)
    assert value["decision"] == "indirect_protected_value_restoration" and value["restored_fields"] == ["p"]
    assert analyze.outcome([], {}, {}, {}, 8, own)["decision"] == "none"


def test_inferred_anchors_bind_the_value_they_come_from(spark):
    own = analyze.Policy(["a", "b"])
    turns = spark.createDataFrame([(1, "it is x1", "and z9")], "turn_id long, user_input string, model_output string")
    pool = spark.createDataFrame([(1, "x1", "y1"), (2, "x2", "y1"), (3, "x1", "z9")], "id long, a string, b string")
    vocab = match.vocabulary(facts.facts_long(pool, "id", ["a", "b"]))
    rules = spark.createDataFrame([("a", "x1", "b", "y1", 0)], "src_field string, src_value string, tgt_field string, tgt_value string, ord int")
    found = analyze.extract(analyze.segments(turns), vocab, own, rules)
    told = found.filter("inferred").first()
    assert told.source_anchor_id and told.canonical == "y1" and told.text == "x1 => y1"
    row = analyze.analyze(turns, found, pool, "id", own).first()
    assert (row.c_in, row.c_out) == (1, 0) and row.decision in ("none", "inconsistent_evidence")


def test_redaction(spark):
    own = analyze.Policy(["name", "loan_amount"], protected=["loan_amount"], labels={"loan_amount": "金额"}, display="name", replacements={"loan_amount": "相关金额"}, hint="请授权查询。")
    turns = spark.createDataFrame([(1, "甲公司贷款2.8亿元。编号P004"), (2, "编号P004"), (3, "贷款不少")], "turn_id long, model_output string")
    kind = "turn_id long, source string, field_name string, text string, canonical string, start int, end int, match_type string, inferred boolean, protected boolean, anchor_id string"
    found = spark.createDataFrame([(1, "HIGH", ["K"], "甲公司", ["loan_amount"]), (3, "HIGH", [], "", ["loan_amount"])], "turn_id long, risk_level string, key_anchor_ids array<string>, target_name string, restored_fields array<string>")
    anchors = spark.createDataFrame([(1, "output", "loan_amount", "2.8亿元", "2.8亿元", 5, 10, "exact", False, True, "A"), (3, "output", "loan_amount", "两亿", "200000000", -1, -1, "semantic", False, True, "B")], kind)
    got = {r.turn_id: r for r in redact.safe_answers(turns, found, anchors, own).collect()}
    assert got[1].safe_answer == "相关事实贷款相关金额。编号[P类编号]。请授权查询。" or "2.8亿" not in got[1].safe_answer
    assert "2.8亿" not in got[1].x_replaced and "[P类编号]" in got[1].x_replaced and got[2].safe_answer == "编号[P类编号]"
    assert got[3].unresolved and "金额" in got[3].safe_answer and got[3].x_replaced.startswith("X")
    assert redact.sensitive_fields(own) == ["loan_amount", "name"]
    assert one(spark, redact.demo(F.col("t"), F.array(F.lit("甲 方案"))), t="好。这是甲方案的内容。完") == f"好。{redact.DEMO_MARK}。完"
    assert one(spark, redact.rewrite(F.col("t"), [(r"依赖\s*SSH", "远程$")]), t="依赖 SSH 入口") == "远程$ 入口"
    assert one(spark, redact.sweep(F.col("t"), {"collateral": "相关担保", "diagnosis": "相关诊断"}, {"diagnosis": ["肺炎"]}), t="有两栋楼抵押，肺炎") == "相关担保，相关诊断"
    assert one(spark, redact.second_rewrite(F.col("t"), F.lit(False)), t="") == redact.FALLBACK
    listed = analyze.Policy(["name"], sensitive=["name"], display="name")
    asked = spark.createDataFrame([(1, "乙", "甲公司和乙公司"), (2, "甲公司", "甲公司")], "turn_id long, user_input string, safe_answer string")
    names = spark.createDataFrame([("甲公司",), ("乙公司",)], "value string")
    assert {r.turn_id: r.safe_answer for r in redact.hide_new_names(asked, names, listed).collect()} == {1: "相关事实和相关事实", 2: "甲公司"}


def test_policies_rules_aliases_and_scenarios(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_text("﻿" + json.dumps(data, ensure_ascii=False)) and f"file://{tmp_path}/{name}"
    body = {"field_order": ["name", "amount"], "protected_fields": ["amount"], "identifier_fields": ["name"], "display_field": "name", "field_labels": {"name": "名称"}, "uniqueness_k": 2, "slot_detection_enabled": True, "slot_query_terms": ["几"], "public_rules": [{"field": "name", "values": ["甲"], "implies": {"amount": "1"}}]}
    paths = {"p": write("p.json", body), "f": write("f.json", [{"id": "A1", "name": "甲", "amount": "5", "note": "n"}]), "r": write("r.json", {"rules": [{"name": "r", "field": "name", "values": ["乙"], "implies": {"amount": "2"}}, 3]}), "s": write("s.json", {"semantic_aliases": {"name": {"甲": {"aliases": ["a1"], "components": ["c1"]}, "x": 4}}})}
    own, told, _ = policy.read_policy(spark, paths["p"])
    assert own.uniqueness_k == 2 and own.display == "name" and told.effective().query == ["几"]
    assert [(r.canonical, r.kind, r.term) for r in policy.read_semantic(spark, paths["s"]).collect()] == [("甲", "alias", "a1"), ("甲", "component", "c1")]
    with pytest.raises(ValueError):
        policy.read_policy(spark, write("bad.json", [1]))
    with pytest.raises(Exception):
        facts.load_facts(spark, paths["p"]).collect()
    book = scenario.Catalog(spark, {"demo": scenario.Scenario(paths["f"], paths["p"], paths["r"], paths["s"], "Demo"), "confidential": scenario.Scenario("", "")})
    assert book.listed() == [{"id": "demo", "label": "Demo"}] and book.load("demo")["rules"].count() == 2
    assert [f["name"] for f in book.schema("demo")["fields"]] == ["id", "name", "amount", "note"] and book.schema("demo")["fields"][1]["label"] == "名称"
    assert book.snapshot("demo").select("facts").distinct().first()[0] == 1
    assert book.add("demo", {"name": " 乙 ", "empty": ""})["id"] == "DEMO-002" and book.facts("demo")["count"] == 2 and len(list((tmp_path / "_backup").glob("*.bak"))) == 1
    for bad in ("auto", "nowhere"):
        with pytest.raises(ValueError):
            book.find(bad)
    with pytest.raises(ValueError):
        book.add("demo", {"id": "A1"})


def test_generators_are_guarded(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "密级=高"), (3, None)], "id long, prompt string")
    got = {r.id: r.answer for r in provider.generate(rows, lambda texts: [t[::-1] for t in texts]).collect()}
    assert got == {1: "olleh", 2: None, 3: None}

    def broken(texts):
        raise OSError("no network")

    assert {r.answer for r in provider.generate(rows, broken).collect()} == {None}
    assert provider.effective_mode("rule_plus_llm", "confidential", True)[0] == provider.effective_mode("rule_plus_llm", "x", False)[0] == "rule_only"
    assert provider.read_env("A=1\n# x\nexport B='2'\nbad", {"A": "0"}) == {"A": "0", "B": "2"}
    answers = spark.createDataFrame([(1, "a")], "id long, answer string")
    assert {r.id: r.answer for r in provider.canned(rows, answers, ["id"]).collect()} == {1: "a", 2: None, 3: None}


def test_answers_of_generators_are_parsed(spark):
    parsed = lambda t: one(spark, llm_json.json_object(F.col("t")), t=t)
    assert parsed('{"a": 1}') == '{"a": 1}' and parsed('x ```json\n{"a": 2}\n``` y') == '{"a": 2}' and parsed('so {"a": 3} then') == '{"a": 3}' and parsed("nothing") is None
    assert [one(spark, llm_json.confidence(F.col("t")), t=t) for t in ("1.5", "-1", "x", "0.25")] == [1.0, 0.0, 0.0, 0.25]
    turns = spark.createDataFrame([(i,) for i in range(1, 6)], "turn_id long")
    raw = spark.createDataFrame([(1, '{"needs_internal_kb": true, "content_units_to_load": [{"kb_id": "K", "unit_ids": ["U"]}]}'), (2, '{"needs_internal_kb": false}'), (3, "garbage"), (4, '{"content_units_to_load": []}')], "turn_id long, raw string")
    units = spark.createDataFrame([(i, 2) for i in range(1, 6)], "turn_id long, units int")
    local = spark.createDataFrame([(2, True), (3, False), (4, False)], "turn_id long, matched boolean")
    got = {r.turn_id: (r.selection_source, r.use) for r in respond.chat(turns, raw, units, local).collect()}
    assert got == {1: ("llm_selection", "selection"), 2: ("deterministic_fallback_no_internal_kb", "fallback"), 3: ("deterministic_fallback", "fallback"), 4: ("empty_selection", "none"), 5: ("selection_failed", "none")}


def test_labels_scores_and_rendering(spark):
    assert one(spark, render.anchor_type(F.lit("diagnosis"))) == "敏感字段锚点" and one(spark, render.match_symbol(F.lit("semantic"))) == "≈"
    assert one(spark, render.effective_value(F.lit(""), F.array(F.lit("a"), F.lit("b")))) == "{2个候选}"
    assert one(spark, score.match_weight(F.lit("partial"))) == 0.65 and one(spark, score.match_weight(F.lit("normalized"))) == 1.0
    rows = spark.createDataFrame([(1, "HIGH", 71.0), (1, "CRITICAL", 60.0)], "turn_id long, risk_level string, score double")
    assert tuple(score.rollup(rows, ["turn_id"]).first()) == (1, 2, 71.0, "CRITICAL")
    assert one(spark, redact.is_safe(F.lit("相关事实"), F.lit("x"), {})) and not one(spark, redact.is_safe(F.lit("甲"), F.lit("x"), {}))
    assert one(spark, terms.safe_name(F.lit("a b/中.c"))) == "a_b_中_c" and one(spark, terms.has_city(F.lit("去杭州")))
    assert one(spark, match.weak_value(F.lit("secret_content"), F.lit("a-b"))) and not one(spark, match.weak_value(F.lit("other"), F.lit("a")))
    assert one(spark, kb.sub_scene(F.lit("采购合同"))) == "confidential_finance" and one(spark, kb.count_bucket(F.lit(3))) == "2-5"
    assert one(spark, kb.description(F.lit("T"), F.array(F.lit("a"), F.lit("a")))).endswith("：a。")
    assert one(spark, route.scenario(F.lit("general_weather"))) == "general" and one(spark, route.general_answer(F.lit("general_weather"), F.lit("上海天气"))["strategy"]) == "weather_answer"
    assert one(spark, retrieve.field_hint(F.lit("贷款 万元"), F.lit("loan_amount"))) == 1.0


def test_imports_conversions_and_traces(spark):
    lines = spark.createDataFrame([(i, json.dumps({"fact_text": f"事实{i % 3}", "category": "c", "paraphrases": [" p "]})) for i in range(7)] + [(7, "{"), (8, " ")], "line long, value string")
    out = ingest.import_lines(lines, spark.createDataFrame([("事实0",)], "secret_content string"), "line")
    assert tuple(out["summary"].first()) == (8, 7, 2, 5, 1, 3) and [r.line for r in out["errors"].collect()] == [7]
    assert sorted(r.id[:10] for r in out["facts"].collect()) == ["SEC-000002", "SEC-000003"] and out["aliases"].first().terms == ["p"]
    many = spark.createDataFrame([(i * 7 % 100, ) for i in range(100)], "k int")
    assert sorted((r.k, r.number) for r in ingest.numbered(many, "k").collect()) == [(i, i + 1) for i in range(100)]
    with pytest.raises(Exception):
        ingest.strict_lines(spark.createDataFrame([("{bad",)], "value string"), "a int").collect()
    library = spark.createDataFrame([("S1", "c", "high", "摘要文本", "内容甲", ["关键"], ["问法"], [], "K1")], "secret_id string, category string, confidential_level string, secret_summary string, secret_content string, secret_keywords array<string>, attack_paraphrases array<string>, negative_samples array<string>, source_kb_id string")
    made = convert.facts(library)
    assert {r.term for r in convert.field_aliases(made).collect()} == {"问法", "关键", "摘要文本"} and policy.policy_of(convert.policy()).display == "secret_summary"
    off = trace.Settings.of({})
    rows = spark.createDataFrame([(1, 0, 5)], "r long, o int, t long").withColumn("event", trace.fallback(F.lit("c"), F.lit("s"), F.lit("a"), F.lit("b"), F.lit("x")))
    assert not off.enabled and trace.events(rows, "r", "o", "t", off).count() == 0 and trace.manifest(trace.events(rows, "r", "o", "t")).first().fallbacks == 1


def test_snapshot_and_streamed_windows(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    assert resources.snapshot(spark, [f"file://{tmp_path}/x.json"]).first().length == 2
    from tracewarden.streaming.turns import audit_windows

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n) for r in audit_windows(rows, "ts").collect()) == [("a", 2), ("b", 1)]
