import hashlib
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewarden.functions import diff
from tracewarden.operators import redact, render, verify
from tracewarden.sources import resources


def plain(a, b):
    """Segments by definition: the table of common lengths by recursion, read from its end."""

    @cache
    def common(i, j):
        if not i or not j:
            return 0
        return common(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(common(i - 1, j), common(i, j - 1))

    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j, step = i - 1, j - 1, ("equal", a[i - 1])
        elif j and (not i or common(i, j - 1) >= common(i - 1, j)):
            j, step = j - 1, ("insert", b[j - 1])
        else:
            i, step = i - 1, ("delete", a[i - 1])
        if out and out[-1][0] == step[0]:
            out[-1] = (step[0], step[1] + out[-1][1])
        else:
            out.append(step)
    return out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ，", max_size=14), st.text("ab ，", max_size=14))
def test_diff_by_definition(a, b):
    assert diff.segments(a, b) == plain(diff.tokens(a), diff.tokens(b))


def test_diff_over_blocks(monkeypatch):
    a, b = "a b c d e f g h".split(), "x b a d c f e h y".split()
    monkeypatch.setattr(diff, "BLOCK", 2)
    assert diff.segments(" ".join(a), " ".join(b)) == plain(diff.tokens(" ".join(a)), diff.tokens(" ".join(b)))


def test_diff_column(spark):
    rows = spark.createDataFrame([("甲，乙", "甲，丙"), (None, "x"), (None, None), ("", "")], "a string, b string").select(diff.text_diff("a", "b").alias("x")).collect()
    assert [[tuple(s) for s in r.x] for r in rows] == [[("equal", "甲，"), ("delete", "乙"), ("insert", "丙")], [("insert", "x")], [], []]


def test_versions(spark):
    q = lambda t, term: spark.createDataFrame([(t, term)], "t string, n string").select(redact.fuzz_version(F.col("t"), F.col("n")).alias("x")).first().x
    term = "xz-utils 5.6.1"
    assert q("XZ utils v5.6.1 and xz_utils:5.6.1, 5.6 系列, v5.6.1", term) == "X and X, X, X"
    assert q("5.6 分支中的受影响版本", term) == "X"
    assert q("5.6.10 and 15.6.1 and 5.6", term) == "5.6.10 and 15.6.1 and 5.6"
    assert q("a (b) c", "(b)") == "a X c"
    assert q(None, term) is None


def test_verification(spark):
    cols = "anchor_id int, field_name string, text string, canonical string, accepted array<string>, source string, expected_source string, source_text string, match_type string, confidence double, start int, end int"
    ok = (1, "f", "abc", "v1", ["v1", "v2", "no"], "input", "input", "x ABC", "semantic", 0.9, 0, 0)
    change = lambda i, **kw: (i, *[kw.get(c.split()[0], v) for c, v in list(zip(cols.split(", "), ok))[1:]])
    rows = [ok, change(2, source="output"), change(3, field_name="g"), change(4, text="zzz"), change(5, canonical="no", accepted=None), change(6, confidence=0.1), change(7, canonical="no"),
            change(8, text="zzz", match_type="inferred", start=4, end=6), change(9, accepted=["v1", "v2", "v3"]), change(10, text=None), change(11, canonical=None)]
    fields = spark.createDataFrame([("f", "F", True)], "field_name string, label string, protected boolean")
    values = spark.createDataFrame([("f", v) for v in ("v1", "v2", "v3")] + [("g", "v1")], "field_name string, value string")
    out = {r.anchor_id: r for r in verify.verify_anchors(spark.createDataFrame(rows, cols), fields, values, 0.5, 2).collect()}
    assert sorted(out) == [1, 7, 8, 9, 11]
    assert (out[1].text, out[1].start, out[1].end, out[1].canonical, out[1].accepted, out[1].protected, out[1].match_type) == ("ABC", 2, 5, "v1", ["v1", "v2"], True, "semantic")
    assert out[7].canonical == "" and out[11].canonical == ""
    assert (out[8].text, out[8].start, out[8].end) == ("zzz", 4, 6)
    assert out[9].match_type == "ambiguous"


def test_rendering(spark):
    row = spark.sql("select 'r' as name, 'f' as field, array('a', 'b') as vals, map('k', 'v') as imp, array() as none, cast(null as string) as nil, 'S' as s")
    rule = lambda *c: row.select(render.rule_line(*[F.col(x) for x in c]).alias("x")).first().x
    assert rule("name", "field", "vals", "imp") == "- r：当 f 为 a, b 时，k = v"
    assert rule("nil", "field", "none", "imp") == "- ，k = v"
    line = render.fact_line(F.col("s"), F.col("name"), {"system_name": (F.col("name"), "名"), "a": (F.col("field"), "A"), "b": (F.col("nil"), "B")})
    assert row.select(line.alias("x")).first().x == "  [S] r，A=f"
    assert row.select(render.safe_template(F.lit("confidential_finance")).alias("x")).first().x.startswith("系统中存在与该问题相关的涉密经费或采购信息。根据保密管理要求，预算")
    assert row.select(render.safe_template(F.lit(None)).alias("x")).first().x == render.GENERAL
    assert row.select(render.slot_answer(F.col("nil")).alias("x"), render.slot_answer(F.col("s")).alias("y")).first() == (None, "根据查询到的信息，S为受保护。")


def test_snapshot_and_aliases(spark, tmp_path):
    (tmp_path / "p.json").write_bytes(b"{}")
    assert resources.snapshot(spark, [str(tmp_path / "p.json")]).first().sha256 == hashlib.sha256(b"{}").hexdigest()
    row = spark.createDataFrame([(["另说", " "], "一 关键词，词组", "短短摘要", "得分为81分，预算312万元。好"), (None, None, None, None)], "p array<string>, k string, s string, c string")
    got = [r.x for r in row.select(resources.alias_terms(F.col("c"), F.col("p"), F.col("k"), F.col("s")).alias("x")).collect()]
    assert got == [["另说", "关键词", "词组", "短短摘要", "得分为81分", "预算312万元"], []]
