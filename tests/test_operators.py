import hashlib
import re
import unicodedata
from itertools import combinations

from pyspark.sql import functions as F

from tracewarden.functions import text as tx
from tracewarden.operators import claims, detect, kb, match, redact, reduce, retrieve, score
from tracewarden.sources import facts, ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_spans_count_code_points_and_do_not_overlap(spark):
    rows = spark.createDataFrame([("😀aaa aa", "aa")], "t string, n string").select(tx.spans(F.col("t"), tx.escape_regex(F.col("n")), F.length("n")).alias("x")).first()["x"]
    assert [(r.start, r.end) for r in rows] == [(1, 3), (5, 7)]


def test_boundaries(spark):
    q = lambda text, term: one(spark, F.regexp_count("t", tx.boundary_pattern(F.col("n"))), t=text, n=term)
    assert q("xz 5.6.10", "5.6.1") == 0
    assert q("xz 5.6.1, ok", "5.6.1") == 1
    assert q("The other THE", "the") == 2
    assert q("a$b c", "$b") == 0  # ends in a letter, so the left edge counts too
    assert q("a $b c", "$b") == 1


def test_normal_forms(spark):
    s = "Ａ β＋　x"
    assert one(spark, tx.normalize_retrieval(F.col("t")), t=s) == "a beta+ x"
    assert one(spark, tx.normalize_match(F.col("t")), t=s) == re.sub(r"\s+", "", unicodedata.normalize("NFKC", s).lower())
    assert one(spark, tx.normalize_slot(F.col("t")), t="12.5 亿元，_ok") == "125亿元ok"


def test_grams(spark):
    assert one(spark, tx.cjk_ngrams(F.col("t")), t="心内科 x 病") == ["心内", "内科", "心内科"]
    assert one(spark, tx.grams(F.col("t"), 3), t="ab") == []


def test_canonical_values(spark):
    found = one(spark, tx.normalized_values(F.col("t")), t="贷款2.8亿元，利率LPR+120bp，评级AA+，2024年3月5日，另50000元")
    assert {(r.kind, r.canonical) for r in found} == {("amount", "280000000 CNY"), ("amount", "50000 CNY"), ("rate", "LPR_PLUS_120BP"), ("rating", "AA+"), ("date", "2024-03-05")}


def test_stable_id(spark):
    want = "A" + hashlib.sha256("x|y|True".encode()).hexdigest()[:10].upper()
    assert one(spark, tx.stable_id("A", F.col("a"), F.col("b"), F.lit(True)), a="x", b="y") == want


def test_blocking_finds_what_the_nested_loop_finds(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Alpha beta gamma-delta"), (2, "nothing"), (3, "ALPHABET 12!?")], "id int, text string")
    terms = spark.createDataFrame([("beta gamma",), ("alpha",), ("!?",), ("eta",), ("zz",)], "term string")
    plain = {tuple(r) for r in match.contains_join(texts, terms).select("id", "term").collect()}
    monkeypatch.setattr(match, "HELD_TERMS", 1)
    blocked = [tuple(r) for r in match.contains_join(texts, terms).select("id", "term").collect()]
    assert set(blocked) == plain and len(blocked) == len(plain) == 5


def test_fold_redaction_is_idempotent_and_longest_first(spark):
    fold = lambda t: one(spark, redact.fold(F.col("t"), F.col("n")), t=t, n=["5.6", "5.6.1", "ab$c"])
    assert fold("v 5.6.1 and 5.6 and 5.6.10 ab$c") == "v X and X and 5.6.10 X"
    assert fold(fold("v 5.6.1")) == fold("v 5.6.1")


def test_redaction_helpers(spark):
    assert one(spark, redact.collapse(F.col("t"), ["某企业"]), t="某企业某企业贷款，相关治疗相关治疗") == "某企业贷款，相关治疗"
    assert one(spark, redact.mask_ids(F.col("t")), t="P001 and AB12") == "[P类编号] and [A类编号]"
    assert one(spark, redact.hint(F.col("t"), "请授权。"), t="好") == "好。请授权。"
    assert one(spark, redact.sweep(F.col("t"), {"loan_amount": "相关金额"}), t="共2.8亿元") == "共相关金额"


def test_contributing_skips_emptying_anchors(spark):
    rows = spark.sql("select array(1L,2L,3L,4L) c, array(array(9L), array(1L,2L), array(1L,2L,3L), array(2L)) a")
    assert rows.select(reduce.contributing(F.col("c"), F.col("a")).alias("x")).first()["x"] == [1, 3]


def test_minimal_combinations_are_minimal(spark):
    hits = {1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True}
    rows = spark.createDataFrame([(0, m, h) for m, h in hits.items()], "k int, mask int, hit boolean")
    got = {r.m for r in reduce.minimal_combinations(rows, ["k"]).collect()}
    want = {m for m, h in hits.items() if h and not any(hits[s] and s != m and s & m == s for s in hits)}
    assert got == want == {3, 4}


def test_score_and_level(spark):
    total = score.total(score.base(F.col("d")), score.uniqueness(F.lit(1)), score.gain(F.lit(2.0)), F.lit(1.0))
    assert one(spark, total, d="indirect_asset_restoration") == 95.0
    assert one(spark, total, d="none") is None
    assert one(spark, score.level(F.lit(69.9)), d="x") == "MEDIUM"


def test_bind_is_or_within_and_across(spark):
    pool = facts.facts_long(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, f string, g string"), "id", ["f", "g"])
    anchors = spark.createDataFrame([(7, "f", "a"), (7, "g", "x"), (7, "g", "y"), (8, "f", "b"), (8, "g", "y")], "k int, field_name string, canonical string")
    assert {(r.k, r.candidates) for r in claims.bind(anchors, pool, "k").collect()} == {(7, 2), (8, 0)}


def test_segments(spark):
    got = one(spark, claims.segments(F.col("t")), t="一。 \n二！三")
    assert [(s.start, s.end, s.text) for s in got] == [(0, 1, "一"), (4, 5, "二"), (6, 7, "三")]


def test_kb_terms(spark):
    got = one(spark, kb.query_grams(F.col("t"), ["什么"]), t="韩雪梅提出什么")
    assert got[0] == "韩雪梅提出" and len(got) == len(set(got)) and all(len(a) >= len(b) for a, b in zip(got, got[1:]))
    assert one(spark, kb.signal_terms(F.col("t")), t="abc x abcdefghijklmnop")[0] == "abc"


def test_detectors(spark):
    assert one(spark, detect.refuses(F.col("t")), t="") is True
    assert one(spark, detect.confirmed(F.col("t"), F.array(F.lit("long fragment"))), t="是 long fragment") is True
    assert one(spark, detect.confirmed(F.col("t"), F.array(F.lit("long fragment"))), t="无法确认 是 long fragment") is False


def test_import(spark):
    lines = ['{"fact_text":"one","keywords":["a"," b "]}', "{bad", '{"category":"c"}', '{"fact_text":"one"}', '{"fact_text":"two"}']
    rows = ingest.parse(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    assert rows.filter("error is not null").count() == 2
    kept = ingest.fresh(ingest.normalise(rows.filter("error is null"), "n"), None, "n").orderBy("n").collect()
    assert [(r.id[:10], r.secret_content) for r in kept] == [("SEC-000001", "one"), ("SEC-000003", "two")] and kept[0].secret_keywords == "a；b"


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text('﻿[{"id": "1", "name": "n", "ok": true, "no": false, "x": ""}, {"id": "2", "title": "t"}]')
    rows = facts.load_facts(spark, str(tmp_path / "f.json")).orderBy("position").collect()
    assert [r.display_name for r in rows] == ["n", "t"] and rows[0].fields == {"id": "1", "name": "n", "ok": "True"}
    (tmp_path / "p.json").write_text('{"field_order": ["a"], "protected_fields": ["a"], "field_aliases": {"a": {"x": ["y", "z"]}}, "public_rules": [{"name": "r", "field": "a", "values": ["x"], "implies": {"b": "c"}}]}')
    policy = facts.load_policy(spark, str(tmp_path / "p.json"))
    assert policy["aliases"].count() == 2 and policy["rules"].first().tgt_value == "c" and policy["fields"].first().protected
    (tmp_path / "k.jsonl").write_text('{"kb_id":"k","content_units":[{"unit_id":"u","text":"t"}]}\n\nbad\n{"kb_id":"e","content_units":[]}\n')
    assert [(r.kb_id, r.topic, r.content_units[0].role) for r in facts.load_kb(spark, str(tmp_path / "k.jsonl")).collect()] == [("k", "内部资料", "content")]


def test_bm25_prefers_the_rare(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a")], "k int, text string")
    tokens = F.split("text", " ")
    postings, stats = retrieve.index(docs, tokens, "k")
    got = retrieve.bm25(spark.createDataFrame([(0, "b"), (0, "a")], "q int, token string"), postings, stats, 2.0, "q", "k").orderBy(F.desc("bm25")).first()
    assert got.k == 1


def test_cube_counts_equal_filters(spark):
    data = [(i % 3, i % 2, i % 5) for i in range(40)]
    pool, names = spark.createDataFrame(data, "a int, b int, c int"), ["a", "b", "c"]
    turns = spark.createDataFrame([(0, 1, None, 3), (1, None, None, None), (2, 9, 0, None)], "t int, a int, b int, c int")
    cube = reduce.pool_cube(pool, names)
    for r in range(4):
        for used in combinations(names, r):
            got = {x.t: x.n for x in reduce.with_candidates(turns, cube, names, list(used), "n").collect()}
            for t in turns.collect():
                assert got[t.t] == sum(all(t[f] is None or t[f] == row[names.index(f)] for f in used) for row in data)


def test_every_record_is_ranked(spark):
    from tracewarden.plans import texts

    sf = "/root/testdata/sf0.001"
    got = {(r.item_id, r.doc_id, r.score, r["rank"]) for r in texts.kb_rank_catalog(spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.lower("text").alias("q"))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("([a-z]{9,})"), F.lit(1)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.lower("text").alias("body"), terms.alias("terms"))
    want = {(r.item_id, r.doc_id, r.score, r["rank"]) for r in kb.rank(items.crossJoin(docs), "item_id", "doc_id", "q", "source", "terms", "body").filter(F.col("rank") <= kb.CATALOG).collect()}
    assert got == want and len(want) == kb.CATALOG * items.count()
