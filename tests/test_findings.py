"""Queries on small tables made for one finding each, against their SQL."""

import pandas as pd
from pyspark.sql import functions as F

from tests.oracle import SF, agree
from tracewarden.functions.text import ascii_boundaries
from tracewarden.operators import claims, kb, match, retrieve
from tracewarden.plans import engine, services, texts


def tables(path, **frames):
    for name, frame in frames.items():
        frame.to_parquet(f"{path}/{name}.parquet")
    return str(path)


def test_word_boundaries_are_ascii(spark, tmp_path):
    talk = ["vérales là", "é que", "quené", "que", "was the", "\u00a0 ", "\t", "", None, "naïve?"]
    sf = tables(tmp_path, conversations=pd.DataFrame({"conv_id": range(len(talk)), "turn": 1, "text": talk}))
    agree(spark, texts.intent_router, texts.SQL["intent_router"], sf)
    agree(spark, texts.streaming_turns, texts.SQL["streaming_turns"], sf)
    assert ascii_boundaries(r"\\b\d") == r"\\b\d"


def test_leaks_are_about_the_items_whose_sentence_is_held(spark, tmp_path):
    items = ["Was and. More.", "Thenndre of was the onenndnd was and. More.", "Of. x", "no sentence"]
    sf = tables(tmp_path, benchmark=pd.DataFrame({"item_id": range(4), "text": items}), documents=pd.DataFrame({"doc_id": range(4), "text": ["It WAS  and. x", "thenndre of was the onenndnd was and.", "密级=1", None]}))
    agree(spark, engine.leak_findings, engine.SQL["leak_findings"], sf)
    assert engine.leak_findings(spark, sf).filter(F.col("item_id") == 1).count() == 1


def test_each_value_is_matched_once(spark, tmp_path, monkeypatch):
    n = 600
    part = pd.DataFrame({"p_partkey": range(n), "p_name": [f"gear {i % 3}" for i in range(n)], "p_type": [f"GEAR {i % 5} steel" for i in range(n)], "p_brand": [f"Brand#{i % 7}" for i in range(n)], "p_size": [i % 4 for i in range(n)]})
    sf = tables(tmp_path, part=part.astype({"p_size": "int32"}))
    sizes, whole = [], kb.value_scores
    monkeypatch.setattr(kb, "value_scores", lambda q, v: sizes.append(q.count() * v.distinct().count()) or whole(q, v))
    agree(spark, services.local_matches, services.SQL["local_matches"], sf)
    assert 0 < sizes[0] <= 4 * 17


def test_claims_never_meet_facts(spark):
    pairs = [(i, f, v) for i in range(6) for f, v in (("a", f"x{i % 2}"), ("b", f"y{i % 3}"))] + [(9, "a", "x0"), (9, "a", "x1"), (9, "b", "y0")]
    pool = spark.createDataFrame(pairs, "fact_id long, field_name string, value string")
    held = [("p", "a", "a", "x0"), ("p", "b", "b", "y0"), ("p", "b", "b", "y1"), ("q", "a", "a", "x0"), ("q", "c", "a", "x1"), ("r", "c", "c", "z"), ("s", "b", "b", "y2")]
    needs = spark.createDataFrame(held, "key string, need string, field_name string, value string")
    found = claims.matching(needs, pool, "key")
    assert {r.key: (r.n, r.first) for r in found.collect()} == {"p": (3, 0), "q": (1, 9), "r": (0, None), "s": (2, 2)}
    many = spark.range(3000).select(F.col("id").alias("k"), F.lit("a").alias("field_name"), F.lit("x0").alias("canonical"))
    facts = spark.range(3000).select(F.col("id").alias("fact_id"), F.lit("a").alias("field_name"), F.lit("x0").alias("value"))
    metrics = claims.bind(many, facts, "k")
    assert {r.candidates for r in metrics.select("candidates").distinct().collect()} == {3000}


def test_lines_that_say_the_same_are_analysed_once(spark, tmp_path, monkeypatch):
    parts, n = 130, 400
    part = pd.DataFrame({"p_partkey": range(parts), "p_name": [f"gear {i % 2}" for i in range(parts)], "p_type": "STEEL", "p_brand": [f"Brand#{min(i, 3)}" for i in range(parts)], "p_size": 7}).astype({"p_size": "int32"})
    flags = [("R", "A", "N")[i % 3] for i in range(n)]
    lines = pd.DataFrame({"l_orderkey": [i // 2 for i in range(n)], "l_partkey": [i * 7 % (parts + 2) for i in range(n)], "l_suppkey": 1, "l_linenumber": [i % 2 for i in range(n)], "l_returnflag": flags}).astype({"l_linenumber": "int32"})
    sf = tables(tmp_path, part=part, lineitem=pd.concat([lines, lines[:50], lines[:9].assign(l_returnflag="A")]))
    sizes, whole = [], engine.analyze.extract
    monkeypatch.setattr(engine.analyze, "extract", lambda rows, *rest: sizes.append(rows.count()) or whole(rows, *rest))
    for name in ("analyze_turns", "turn_findings", "turn_chains", "safe_answers", "responses", "reasoning_lines"):
        agree(spark, engine.QUERIES[name], engine.SQL[name], sf)
    assert len(sizes) == 6 and max(sizes) <= 2 * 4 * 3  # a question and an answer for each brand, unnamed or with one of two names


def test_sentences_of_orders_are_analysed_once(spark, tmp_path, monkeypatch):
    """Names that begin or end others' sentences are found in none that doesn't state them."""
    parts, n = 40, 600
    part = pd.DataFrame({"p_partkey": range(parts), "p_name": [f"gear? {i % 3}" if i < 30 else f"rod x{i}" for i in range(parts)], "p_type": "STEEL", "p_brand": [f"Brand#{i % 4}" for i in range(parts)], "p_size": [i % 9 for i in range(parts)]})
    part.loc[39, "p_name"] = "size 0。A Brand#1"
    part = part.astype({"p_size": "int32"})
    told = pd.DataFrame({"l_orderkey": [i // 6 for i in range(n)], "l_partkey": [i * 7 % (parts + 2) for i in range(n)], "l_linenumber": [i % 3 for i in range(n)], "l_returnflag": [("R", "A", "N")[i * i % 3] for i in range(n)]}).astype({"l_linenumber": "int32"})
    told.loc[told["l_partkey"] == 39, "l_returnflag"] = None
    sf = tables(tmp_path, part=part, lineitem=pd.concat([told, told[:60], told[:30].assign(l_returnflag="A"), pd.DataFrame({"l_orderkey": 1000, "l_partkey": [0, 1], "l_linenumber": [1, 2], "l_returnflag": "A"}).astype({"l_linenumber": "int32"})]))
    sizes, whole = [], engine.analyze.extract
    monkeypatch.setattr(engine.analyze, "extract", lambda rows, *rest: sizes.append(rows.count()) or whole(rows, *rest))
    agree(spark, engine.claim_findings, engine.SQL["claim_findings"], sf)
    assert 0 < sizes[0] <= 2 * 2 * parts  # questions and answers of each part, unnamed and named, not of each order


def test_evidence_plans_no_turn_again(spark):
    plan = engine.reasoning_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Join") <= 6


def test_spans_by_the_automaton_are_those_of_the_pattern(spark, monkeypatch):
    said = ["gear 1 Gear 11 xgear 1 gear 1.", "aaaa a.a -a- (a) A", "", None, "::x::: ::", "née gear 1, Gear 1", "a_a a b"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    terms = spark.createDataFrame([("f", t, t) for t in ("gear 1", "a", "aa", "A", "::", "née", "b", "Gear", "")], "field_name string, canonical string, term string")
    for edges in (True, False):
        rows = lambda: sorted(map(tuple, match.literal_anchors(docs, terms, edges).select("doc_id", "canonical", "start", "end").collect()))
        fast = rows()
        with monkeypatch.context() as m:
            m.setattr(match, "HELD_TERMS", 0)
            assert fast and fast == rows()


def test_retrieval_shuffles_no_token(spark, tmp_path):
    said = ["Was the and. The one was, that", "The other thing. And the one", "no sentence the", "", None]
    held = [*["The one was the and. copy"] * 40, "WAS THE AND. that thing was", "the other thing. and the one", "the", "", None, "the one\u212a was the and", *[f"thing {i} the one and the {'was ' * (i % 7)}" for i in range(60)]]
    sf = tables(tmp_path, benchmark=pd.DataFrame({"item_id": range(5), "text": said}), documents=pd.DataFrame({"doc_id": range(len(held)), "text": held, "source": [None if i % 9 == 0 else f"s{i % 4}" for i in range(len(held))]}))
    agree(spark, texts.fused_retrieval, texts.SQL["fused_retrieval"], sf)
    plan = texts.fused_retrieval(spark, sf)._jdf.queryExecution().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "(token" not in plan


def test_retrieval_of_repeated_and_null_ids(spark):
    """The held queries choose what the joined postings give, also where ids repeat."""
    docs = spark.createDataFrame([(1, "a b c the", "f"), (1, "the b", "g"), (2, "a b", "f"), (None, "a the", "f"), (None, "the", "f"), (3, None, "f"), (4, "c a b a", "g")], "doc_id long, text string, field_name string")
    items = spark.createDataFrame([(7, "a b the"), (8, "c a b"), (9, None)], "item_id long, text string")
    terms = spark.createDataFrame([(7, "canonical", "A B"), (8, "clue", "c a"), (8, "alias", "b a")], "item_id long, kind string, term string")
    hits = retrieve.alias_scores(docs, terms, "doc_id", "item_id").select("item_id", "doc_id", "alias")
    got = retrieve.held_scores(docs, items, terms, texts._words(), "item_id", "doc_id", "field_name", per_field=9)
    found = {}
    for gram, score in ((texts._words(), retrieve.bm25), (texts._pairs(), retrieve.overlap)):
        postings, stats = retrieve.index(docs, gram, "doc_id")
        asked = items.select("item_id", F.explode(F.array_distinct(gram)).alias("token"))
        more = (retrieve.average_length(docs, gram),) if score is retrieve.bm25 else ()
        found[score] = score(asked, postings, stats, *more, "item_id", "doc_id")
    want = found[retrieve.bm25].join(found[retrieve.overlap], ["item_id", "doc_id"], "left").join(hits, ["item_id", "doc_id"], "left").fillna(0.0, ["ngram", "alias"]).join(docs.select("doc_id", "field_name"), "doc_id")
    rows = lambda df: sorted((r.item_id, r.doc_id, r.field_name, round(r.bm25, 9), round(r.ngram, 9), r.alias) for r in df.collect())
    ours, theirs = rows(got), rows(want)
    assert [r for r in ours if r[1] != 1] == [r for r in theirs if r[1] != 1]  # of repeated ids, either length may count
    assert [(*r[:3], *r[4:]) for r in ours] == [(*r[:3], *r[4:]) for r in theirs]
    assert retrieve.held_scores(docs, items.unionByName(items), terms, texts._words(), "item_id", "doc_id", "field_name") is None
