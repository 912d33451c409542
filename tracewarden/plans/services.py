"""Routing, knowledge bases, imports, generators, traces and retrieval by field over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import llm_json, terms
from ..functions.text import word_tokens
from ..operators import detect, kb, match, render, respond, retrieve, route
from ..sources import convert, ingest, provider, trace
from ..storage import cut
from .engine import POOL_SQL, pool
from .tables import table


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return route.intents(rows, "key").select("key.conv_id", "key.turn", "domain", F.round("confidence", 3).alias("confidence"), "patterns")


def _intents_sql() -> str:
    hit = lambda p: f"case when regexp_matches(b, '{p}') then 1 else 0 end"
    miss = {d: " * ".join(f"(1 - {w} * {hit(p)})" for p, w in ps) for d, ps in route.DOMAINS.items()}
    n = {d: " + ".join(hit(p) for p, _ in ps) for d, ps in route.DOMAINS.items()}
    medical = f"(contains(b, '{route.CHECK}') and regexp_matches(b, '{route.MEDICAL}'))"
    own = {d: f"1 - {m}" for d, m in miss.items()}
    own["healthcare"] = f"1 - {miss['healthcare']} * case when {medical} then {1 - route.CHECK_WEIGHT} else 1 end"
    n["healthcare"] += f" + case when {medical} then 1 else 0 end"
    weather = own["general_weather"]
    own["general_weather"] = f"case when ({n['general_weather']}) > 0 and regexp_matches(b, '{route.TIMES}') then least(1.0, ({weather}) * {route.WEATHER_FACTOR}) else {weather} end"
    cols = ", ".join(f"cast({own[d]} as double) as s_{d}, {n[d]} as n_{d}" for d in own)
    best = f"greatest({', '.join(f's_{d}' for d in own)})"
    pick = lambda x: "case " + " ".join(f"when s_{d} = {best} then {x(d)}" for d in own) + " end"
    return f"""with c as (select conv_id, turn, lower(coalesce(text, '')) as b from conversations), s as (select conv_id, turn, b, {cols} from c),
r as (select *, {best} >= {route.THRESHOLD} and trim(b) <> '' as sure from s)
select conv_id, turn, case when sure then {pick(lambda d: f"'{d}'")} else 'general_chat' end as domain,
  case when trim(b) = '' then 0.5 when sure then round({best}, 3) else 0.3 end as confidence, case when sure then {pick(lambda d: f'n_{d}')} else 0 end as patterns from r"""


def answer_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by turn, asked of finance on every third turn and left to the router on the others."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("turn_id"), F.col("text").alias("user_input"), F.when(F.col("turn") % 3 == 0, "finance").otherwise("auto").alias("scenario"))
    return respond.strategy(rows).select("turn_id.conv_id", "turn_id.turn", "intent", "routed_scenario", "answer_strategy")


STRATEGIES = f"""
with i as ({_intents_sql()}), r as (select *, case when turn % 3 = 0 then 'finance' when domain in ('healthcare', 'finance', 'aerospace', 'meetings') then domain else 'general' end as routed_scenario from i)
select conv_id, turn, domain as intent, routed_scenario, case when routed_scenario <> 'general' then 'cfa_gated' when domain = 'general_weather' then 'need_city_prompt' else 'general_answer' end as answer_strategy from r
"""


def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans made of orders: amounts, rates, ratings and dates of a text for the fields that call for them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("贷款"), F.col("o_custkey").cast("string"), F.lit("万元，利率LPR+"), (F.col("o_custkey") % 900 + 100).cast("string"), F.lit("bp，主体评级AA+，"), F.date_format("o_orderdate", "yyyy年M月d日")).alias("text"))
    found = terms.normalized_anchors(rows, ["loan_amount", "interest_rate", "credit_rating", "due_date", "branch"], ["o_orderkey"])
    return found.select("o_orderkey", "field_name", "canonical").distinct()


NORMALIZED = """
select o_orderkey, 'loan_amount' as field_name, concat(cast(o_custkey as bigint) * 10000, ' CNY') as canonical from orders where o_custkey > 0
union all select o_orderkey, 'interest_rate', concat('LPR_PLUS_', o_custkey % 900 + 100, 'BP') from orders union all select o_orderkey, 'credit_rating', 'AA+' from orders
union all select o_orderkey, 'due_date', strftime(o_orderdate, '%Y-%m-%d') from orders
"""


def component_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as texts against descriptions made of names and types."""
    part = table(spark, sf_dir, "part")
    values = part.select(F.concat_ws("、", "p_name", F.lower("p_type")).alias("value"), F.col("p_partkey").alias("position"))
    texts = part.select("p_partkey", F.concat_ws(" / ", "p_type", "p_name").alias("text"))
    return terms.component_matches(texts, values, "p_partkey")


COMPONENTS = """
with v as (select p_name || '、' || lower(p_type) as value, p_partkey as position, unnest([p_name, lower(p_type)]) as c from part),
f as (select c, arg_min(value, position) as canonical from v where length(c) >= 3 group by c)
select p_partkey, c as component, canonical from part join f on contains(lower(p_type || ' / ' || p_name), c)
"""


def _import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("props").alias("fact_text"), F.col("event_type").alias("category"), F.array("event_type").alias("keywords")))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "{broken").when(F.col("event_id") % 13 == 0, '{"category": "x"}').otherwise(body).alias("value"))


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of events says: lines, errors and their kinds, duplicates, facts by category."""
    out = ingest.import_lines(_import_lines(spark, sf_dir), None, "event_id")
    long = out["summary"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in ("lines", "parsed", "imported", "duplicates", "errors", "total")])).alias("x")).select("x.*")
    kinds = out["errors"].groupBy(F.concat(F.lit("error "), "error").alias("name")).agg(F.count("*").alias("n"))
    shown = out["aliases"].select(F.lit("alias terms").alias("name"), F.sum(F.size("terms")).alias("n"))
    return long.unionByName(kinds).unionByName(out["categories"].select(F.concat(F.lit("category "), "value").alias("name"), "n")).unionByName(shown)


IMPORT_REPORT = """
with l as (select event_id, event_type, trim(props) as f, case when event_id % 11 = 0 then 'bad json' when event_id % 13 = 0 or coalesce(trim(props), '') = '' then 'missing fact_text' end as error from events),
p as (select * from l where error is null), d as (select f, arg_min(event_type, event_id) as event_type from p group by f)
select 'lines' as name, count(*) as n from l union all select 'parsed', count(*) from p union all select 'imported', count(*) from d union all select 'duplicates', (select count(*) from p) - count(*) from d
union all select 'errors', count(*) from l where error is not null union all select 'total', count(*) from d
union all select 'error ' || error, count(*) from (select error from l where error is not null order by event_id limit 20) group by error
union all select 'category ' || event_type, count(*) from p group by event_type
union all select 'alias terms', cast(sum(2 - case when substr(f, 1, 60) = f then 1 else 0 end - case when event_type = f or event_type = substr(f, 1, 60) then 1 else 0 end) as bigint) from d
"""


def kb_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as knowledge-base lines: in units, as one content, without an id, broken."""
    own = F.struct(F.col("item_id").cast("string").alias("kb_id"), F.lit("T").alias("topic"), F.array(F.struct(F.lit("U1").alias("unit_id"), F.col("text")), F.struct(F.lit("U2").alias("unit_id"), F.lit(" ").alias("text"))).alias("content_units"))
    whole = F.struct(F.col("item_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    place = F.col("item_id") % 4
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.when(place == 0, F.to_json(own)).when(place == 1, F.to_json(whole)).when(place == 2, F.to_json(F.struct(F.lit("T").alias("topic")))).otherwise("{broken").alias("value"))
    good, bad = ingest.list_kb(lines, "item_id")
    rows = good.select(F.col("line").cast("long").alias("line"), "title", F.size("content_units").alias("units"), F.col("content_units")[0]["role"].alias("role"), F.sha2(F.col("content_units")[0]["text"], 256).alias("text_sha256"), F.lit("").alias("error"))
    return rows.unionByName(bad.select(F.col("line").cast("long").alias("line"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("units"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text_sha256"), "error"))


KB_LISTING = """
select item_id as line, case when item_id % 4 = 0 then 'T' when item_id % 4 = 1 then cast(item_id as varchar) end as title, case when item_id % 4 < 2 then 1 else 0 end as units,
  case when item_id % 4 < 2 then 'content' end as role, case when item_id % 4 < 2 then sha256(trim(text)) end as text_sha256,
  case when item_id % 4 = 2 then 'missing kb_id/doc_id' when item_id % 4 = 3 then 'bad json' else '' end as error from benchmark
"""


def kb_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as raw documents, sentence by sentence, with retrieval terms of the nation whose name ends they hold most."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.concat(F.lit("Item 2024-"), F.col("item_id").cast("string"), F.lit(" notes")).alias("title"), F.regexp_replace("text", r"\.\s", "。").alias("content"), F.lit("Desk").alias("department"))
    nations = table(spark, sf_dir, "nation")
    secrets = nations.select(F.col("n_nationkey").alias("secret_id"), F.col("n_nationkey").alias("position"), F.array(F.lower(F.substring("n_name", 1, 2)), F.lower(F.substring("n_name", -2, 2))).alias("secret_keywords"))
    made = convert.knowledge(rows, secrets)
    return made.select("kb_id", F.array_join("retrieval_terms", "|").alias("retrieval_terms"), F.size("content_units").alias("units"), F.array_join(F.transform("content_units", lambda u: F.concat(u["unit_id"], F.lit(":"), u["role"])), "|").alias("roles"))


KB_CONVERSION = r"""
with d as (select item_id, regexp_replace(text, '\.\s', '。', 'g') as content, 'Item 2024-' || item_id || ' notes' as title from benchmark),
s as (select n_nationkey as k, lower(substr(n_name, 1, 2)) as a, lower(right(n_name, 2)) as b from nation),
h as (select item_id, k, a, b, case when contains(title || chr(10) || content, a) then 1 else 0 end + case when contains(title || chr(10) || content, b) then 1 else 0 end as hits from d, s),
x as (select item_id, arg_max(a, (hits, -k)) as a, arg_max(b, (hits, -k)) as b, max(hits) as hits from h group by item_id),
p as (select item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(content), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '') as parts from d),
u as (select item_id, len(parts) as n, list_transform(range(1, len(parts) + 1), lambda i: 'U' || i || ':' || case when i = 1 then 'background_context' when i = len(parts) then 'response_boundary'
  when regexp_matches(parts[i], '[\d.]+|[百千万亿]元|TB|GB|分|台|次|人|个') then 'semantic_anchor_object' else 'semantic_anchor_background' end) as roles from p),
w as (select item_id, case when hits > 0 then case when a = b then ['Item', 'notes', 'Desk', a] else ['Item', 'notes', 'Desk', a, b] end else ['Item', 'notes', 'Desk'] end as terms from x)
select cast(u.item_id as varchar) as kb_id, array_to_string(terms, '|') as retrieval_terms, cast(n as integer) as units, array_to_string(roles, '|') as roles from u join w using (item_id)
"""


def kb_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator's choice of units for each source: every document's first lines, twice, in order of ids; checked against what is there."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("kb_id"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    records = docs.select("source", "kb_id", F.lit("T").alias("topic"), F.transform("lines", lambda t, i: F.struct(F.concat(F.lit("U"), i.cast("string")).alias("unit_id"), F.lit("content").alias("role"), t.alias("text"))).alias("content_units"))
    available = records.select("source", "kb_id", F.explode("content_units.unit_id").alias("unit_id"))
    wanted = F.explode(F.flatten(F.array_repeat(F.array(*[F.struct(F.lit(f"U{i}").alias("unit_id"), F.lit(i).alias("i")) for i in range(6)]), 2)))
    chosen = docs.select("source", "kb_id", (F.col("doc_id") * 10).alias("base"), wanted.alias("w")).select("source", "kb_id", "w.unit_id", (F.col("base") + F.col("w.i")).alias("ord"))
    picked = kb.selected_units(kb.checked_selection(chosen, available, "source"), records.drop("source"), "source")
    return picked.select("source", "kb_id", "unit_id", F.col("position").cast("long").alias("position"), F.sha2("text", 256).alias("text_sha256"))


KB_SELECTION = """
with d as (select source, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), u as (select source, doc_id, l, unnest(range(0, 6)) as i from d), h as (select * from u where i < len(l)),
r as (select *, dense_rank() over (partition by source order by doc_id) as r from h), s as (select *, row_number() over (partition by source order by doc_id, i) as position from r where r <= 3)
select source, cast(doc_id as varchar) as kb_id, 'U' || i as unit_id, position, sha256(l[i + 1]) as text_sha256 from s where position <= 12
"""


def kb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as questions, parts as records: those that rank none get the first records."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("topic"), F.array(F.lower("p_type")).alias("terms"), F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("body"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("standard "), F.lower("n_name"))).otherwise("§§").alias("q"))
    ranked = kb.rank_all(asked, part, "n_nationkey", "p_partkey", "q", "topic", "terms", "body")
    return kb.catalog(ranked, part, asked, "n_nationkey", "p_partkey").groupBy("n_nationkey").agg(F.count("*").alias("records"), F.min("place").cast("long").alias("first"), F.max(F.when(F.col("n_nationkey") % 2 == 1, F.col("p_partkey"))).alias("last_of_first"))


KB_CATALOG = """
with f as (select max(p_partkey) as last from (select p_partkey from part order by p_partkey limit 30)), n as (select count(*) as n from (select p_partkey from part limit 30))
select n_nationkey, n as records, 1 as first, case when n_nationkey % 2 = 1 then last end as last_of_first from nation, f, n
"""

LOCAL_FIELDS = {"secret_content": "p_name", "secret_summary": "p_type", "category": "p_brand"}


def local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of parts as questions against all parts as confidential records; the size-1 parts' types are negative samples."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.lower("p_name").alias("q")).distinct()
    # Records with the same texts have the same points: they are scored once, and of each such kind no more than the least
    # ids can be among the best; each value is matched once.
    same = ["p_name", "p_type", "p_brand", "bad"]
    least = part.withColumn("bad", F.col("p_size") == 1).withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("p_partkey"))).filter(F.col("_n") <= kb.LOCAL_TOP)
    kinds = least.groupBy(*same).agg(F.min("p_partkey").alias("first"), F.collect_list("p_partkey").alias("ids"))
    plain = {column: terms.normalize_plain(F.col(column)) for column in LOCAL_FIELDS.values()}
    points = cut(kb.value_scores(asked, part.select(F.explode(F.array(*plain.values())).alias("value"))))
    sides = {c: points.select(F.col("q").alias(f"q_{c}"), F.col("value").alias(f"v_{c}"), F.col("points").alias(f"x_{c}")) for c in plain}
    rows = kinds.join(F.broadcast(asked) if asked.limit(5_001).count() <= 5_000 else asked)
    for c, side in sides.items():
        rows = rows.join(side, (F.col("q") == F.col(f"q_{c}")) & (plain[c] == F.col(f"v_{c}")), "left").drop(f"q_{c}", f"v_{c}")
    at = {c: F.coalesce(f"x_{c}", F.lit(0.0)) for c in plain}
    none = F.array().cast("array<double>")
    score = kb.local_points({name: at[c] for name, c in LOCAL_FIELDS.items()}, none, F.array(at["p_type"]), F.when(F.col("bad"), F.array(at["p_name"])).otherwise(none))
    scored = kb.local_matches(rows.select("q", F.round(score, 9).alias("score"), "first", "ids"), "q", "first").select("q", "score", F.explode("ids").alias("p_partkey"))
    best = kb.local_matches(scored, "q", "p_partkey").withColumn("sub_scene", kb.sub_scene(F.col("q")))
    told = kb.classify(asked, best, "q", "p_partkey")
    return best.join(told.select("q", "match_count"), "q").select("q", "p_partkey", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "match_count", "sub_scene")


def _tokens_sql(x: str) -> str:
    grams = " ".join(f", list_transform(range(1, length(regexp_replace({x}, '\\s+', '', 'g')) - {n - 2}), lambda i: substr(regexp_replace({x}, '\\s+', '', 'g'), i, {n}))" for n in (2, 3, 4))
    return f"list_distinct(list_concat(regexp_extract_all({x}, '[A-Za-z0-9★\\-]+'){grams}))"


def _match_sql(v: str) -> str:
    return f"(case when contains(q, {v}) then 3.0 when contains({v}, q) and length(q) >= 4 then 2.0 else len(list_intersect(qt, {v}_t)) / len(qt) end)"


LOCAL_MATCHES = f"""
with a as (select q, {_tokens_sql('q')} as qt from (select distinct lower(p_name) as q from part)),
r as (select p_partkey, p_size = 1 as bad, lower(p_name) as n, lower(p_type) as t, lower(p_brand) as b from part), k as (select distinct bad, n, t, b from r),
g as (select *, {_tokens_sql('n')} as n_t, {_tokens_sql('t')} as t_t, {_tokens_sql('b')} as b_t from k),
s as (select q, bad, n, t, b, 3.0 * {_match_sql('n')} + 2.0 * {_match_sql('t')} + 0.5 * {_match_sql('b')} + 1.5 * {_match_sql('t')} + 2.0 * {_match_sql('t')} - case when bad and {_match_sql('n')} >= 1.5 then 12 else 0 end as raw from a, g),
j as (select q, p_partkey, round(raw, 9) as score from s join r on r.bad = s.bad and r.n = s.n and r.t = s.t and r.b = s.b where raw > 0),
o as (select *, row_number() over (partition by q order by score desc, p_partkey) as rank, count(*) over (partition by q) as c from j)
select q, p_partkey, round(score, 6) as score, rank, least(c, 5) as match_count, 'confidential_general' as sub_scene from o where rank <= 5
"""


def sanitized_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt may be told of the parts: counts by sub-scene and a bucket of matches for each segment of customers."""
    parts = table(spark, sf_dir, "part").select(kb.sub_scene(F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, "服务器"))).alias("sub_scene"))
    asked = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("turn_id")).agg(F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1)).alias("match_count"))
    asked = asked.select("turn_id", (F.col("match_count") > 0).alias("matched"), F.lit("confidential_system").alias("sub_scene"), "match_count")
    told = respond.sanitized_knowledge(parts, asked, parts.count())
    body = F.from_json("knowledge", "struct<total_records:bigint,coverage:map<string,bigint>,current_query:struct<related:boolean,safe_topic:string,matched_count_bucket:string>>")
    held = F.size(detect.payload_violations(F.col("knowledge")))
    return told.select("turn_id", body.alias("k"), held.alias("violations")).select("turn_id", "k.total_records", F.col("k.coverage")["confidential_system"].alias("systems"), F.col("k.coverage")["confidential_project"].alias("projects"), "k.current_query.related", "k.current_query.matched_count_bucket", "violations")


SANITIZED = """
with c as (select c_nationkey as turn_id, count(*) filter (c_mktsegment = 'BUILDING') as m from customer group by 1)
select turn_id, (select count(*) from part) as total_records, (select count(*) from part where p_size > 25) as systems, 0 as projects, m > 0 as related,
  case when m = 0 then '0' when m = 1 then '1' when m <= 5 then '2-5' else '>5' end as matched_count_bucket, 0 as violations from c
"""


def payload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads: those that hold forbidden keys, as a catalog and as selected units."""
    key = F.element_at(F.array(*map(F.lit, ["risk_level", "text", "content_units", "k", "SEC-1", "retrieval_terms"])), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.concat(F.lit('{"'), key, F.lit('": 1, "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("payload"))
    return rows.select("event_id", F.array_join(detect.payload_violations(F.col("payload")), ",").alias("unit_hits"), F.array_join(detect.payload_violations(F.col("payload"), True), ",").alias("catalog_hits"))


PAYLOAD_GUARD = """
select event_id, case event_id % 6 when 0 then 'risk_level' when 4 then 'SEC-' when 5 then 'retrieval_terms' else '' end as unit_hits,
  case event_id % 6 when 0 then 'risk_level' when 1 then 'text' when 2 then 'content_units' when 4 then 'SEC-' when 5 then 'retrieval_terms' else '' end as catalog_hits from events
"""


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that answers with the beginning of its prompt; prompts that hold a marker are not sent."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, F.concat(F.lit("密级= "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("prompt"))
    out = provider.generate(rows, lambda prompts: [f"re: {p[:40]}" for p in prompts])
    return out.select("conv_id", "turn", "answer", F.array_join("blocked", ",").alias("blocked"))


GENERATED = "select conv_id, turn, case when turn % 5 <> 0 then 're: ' || substr(coalesce(text, ''), 1, 40) end as answer, case when turn % 5 = 0 then '密级=' else '' end as blocked from conversations"


def last_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of users' requests: the newest payload of each purpose; those that hold a marker are withheld."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("purpose"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "SEC-9").otherwise(F.coalesce("props", F.lit(""))).alias("prompt"))
    newest = provider.last_payload(provider.requests(calls, "m"))
    return newest.select("request_id", "purpose", "call_id", "status", F.get_json_object("payload", "$.messages[0].content").alias("content"))


LAST_PAYLOADS = """
with r as (select *, row_number() over (partition by user_id order by event_id) as n from events), l as (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from r)
select user_id as request_id, event_type as purpose, concat_ws('_', user_id, event_type, printf('%03d', n)) as call_id, case when event_id % 3 = 0 then 403 else 200 end as status, case when event_id % 3 <> 0 then coalesce(props, '') end as content from l where k = 1
"""


def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as traces: each event opens a span that its end or an error closes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", F.explode(F.array(F.lit("start"), F.when(F.col("event_type") == "error", "error").otherwise("end"))).alias("kind"))
    ident = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    rows = rows.withColumn("order", F.col("event_id") * 2 + (F.col("kind") != "start").cast("int")).withColumn("event", trace.event(F.lit("engine"), F.col("event_type"), F.col("kind"), span=ident))
    told = trace.events(rows, "user_id", "order", "ts")
    paired = trace.spans(told).groupBy("request_id").agg(F.count("*").alias("spans"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return trace.manifest(told).join(paired, "request_id").select("request_id", "event_count", "errors", "status", "spans", "failed", "folder")


TRACE_SPANS = """
with c as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as e from events group by 1)
select user_id as request_id, 2 * n as event_count, e as errors, case when e > 0 then 'failed' else 'success' end as status, n as spans, e as failed, cast(user_id as varchar) as folder from c
"""


def semantic_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators' proposals for parts, in free text around JSON: evidence in the text, recalled values, clamped confidence."""
    part = table(spark, sf_dir, "part")
    anchors = F.array(
        F.struct(F.lit("p_type").alias("field_name"), F.lower("p_type").alias("source_text"), F.lit("1.7").alias("confidence"), F.lit("odd").alias("match_type"), F.col("p_type").alias("canonical_value"), F.array("p_brand").alias("accepted_values")),
        F.struct(F.lit("p_brand").alias("field_name"), F.lit("nowhere").alias("source_text"), F.lit("0.9").alias("confidence"), F.lit("exact").alias("match_type"), F.col("p_brand").alias("canonical_value"), F.array("p_brand").alias("accepted_values")),
        F.struct(F.lit("p_name").alias("field_name"), F.col("p_name").alias("source_text"), F.lit("bad").alias("confidence"), F.lit("exact").alias("match_type"), F.col("p_name").alias("canonical_value"), F.array("p_name").alias("accepted_values")),
        F.struct(F.lit("p_brand").alias("field_name"), F.col("p_brand").alias("source_text"), F.lit("0.6").alias("confidence"), F.lit("alias").alias("match_type"), F.lit("other").alias("canonical_value"), F.array(F.lit("x"), F.col("p_brand"), F.col("p_brand")).alias("accepted_values")),
    )
    raw = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(anchors.alias("anchors"))), F.lit("\n```"))
    rows = part.select("p_partkey", F.lit("output").alias("source"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), raw.alias("llm_json"))
    recalled = part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("p_type", "p_brand", "p_name")])).alias("v")).select("p_partkey", "v.*")
    out = llm_json.semantic_anchors(rows, recalled, ["p_type", "p_brand", "p_name"], 0.4, 30, ["p_partkey"])
    return out.select("p_partkey", "field_name", "text", "canonical", F.array_join("accepted", "|").alias("accepted"), F.col("start").cast("long").alias("start"), "confidence", "match_type")


SEMANTIC = """
with p as (select *, p_name || ' ' || p_type || ' ' || p_brand as x, lower(p_type) as e from part), q as (select *, case when contains(x, e) then strpos(x, e) else strpos(lower(x), e) end as pos from p)
select p_partkey, 'p_type' as field_name, substr(x, pos, length(e)) as text, p_type as canonical, '' as accepted, pos - 1 as start, 1.0 as confidence, 'ambiguous' as match_type from q
union all select p_partkey, 'p_brand', p_brand, '', p_brand, strpos(x, p_brand) - 1, 0.6, 'alias' from q
"""


def field_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate values of the parts' fields for questions made of each brand, type and name: all four signals, cut by field."""
    facts, policy = pool(spark, sf_dir), ["p_brand", "p_type", "p_name"]
    long = facts.select("p_partkey", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in policy])).alias("field_rank", "x")).select("x.*", "field_rank", F.col("p_partkey").alias("position"))
    labels = spark.createDataFrame([(f, f[2:]) for f in policy], "field_name string, label string")
    docs = retrieve.candidate_documents(long, labels)
    asked = facts.groupBy("p_type", "p_name").agg(F.min("p_brand").alias("b")).select(F.concat_ws("/", "p_type", "p_name").alias("query_id"), F.lower(F.concat_ws(" ", "p_name", "p_type", "b", F.lit("版本 漏洞"))).alias("text"))
    tokens = word_tokens(F.lower("text"))
    postings, stats = retrieve.index(docs, tokens, "doc_id")
    words = asked.select("query_id", F.explode(F.array_distinct(tokens)).alias("token"))
    bm = retrieve.bm25(words, postings, stats, retrieve.average_length(docs, tokens), "query_id", "doc_id")
    ng = retrieve.overlap(words, postings, stats, "query_id", "doc_id")
    own = docs.select("doc_id", F.lit("canonical").alias("kind"), F.col("value").alias("term"))
    al = retrieve.alias_scores(asked, own, "query_id", "doc_id").select("query_id", "doc_id", "alias")
    rows = bm.join(ng, ["query_id", "doc_id"], "full").join(al, ["query_id", "doc_id"], "full").fillna(0.0, ["bm25", "ngram", "alias"]).join(docs.select("doc_id", "field_name", "value"), "doc_id").join(asked, "query_id")
    fused = retrieve.fuse(F.col("bm25"), F.col("ngram"), F.col("alias"), retrieve.field_hint(F.col("text"), F.col("field_name"), {"p_name": ["版本", "漏洞"]}))
    rows = rows.withColumn("score", F.round(fused, 9))  # sums of floats differ in their last digits by the order of addition
    ranked = retrieve.cut_top(rows, "query_id", "field_name", "doc_id", per_field=2, top=5)
    told = retrieve.stats(ranked, "query_id")
    return ranked.join(told, "query_id").select("query_id", "field_name", "value", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"), "candidates", F.round("max_score", 5).alias("max_score"), F.array_join("top_fields", ",").alias("top_fields"))


_WT = "list_concat(list_concat(regexp_extract_all(x, '[a-z]+'), list_distinct(list_filter(regexp_extract_all(x, '\\d+(?:\\.\\d+)*'), lambda v: true))), list_distinct(list_filter(regexp_extract_all(x, '[a-z0-9]+(?:[-_.+][a-z0-9]+)+'), lambda v: not list_contains(regexp_extract_all(x, '[a-z]+'), v))))"
FIELD_RETRIEVAL = f"""
with {POOL_SQL}, v as (select distinct f, v from (select unnest(['p_brand', 'p_type', 'p_name']) as f, unnest([p_brand, p_type, p_name]) as v from pool)),
d as (select f || '=' || v as doc_id, f, v, lower(f || ' | ' || substr(f, 3) || ' | ' || v) as x from v), dt as (select doc_id, f, v, {_WT} as w from d), st as (select count(*) as total, avg(len(w)) as avgdl from dt),
tf as (select doc_id, t, count(*) as tf, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as t from dt) group by 1, 2), df as (select t, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, st group by t, total),
q0 as (select concat(p_type, '/', p_name) as query_id, lower(concat_ws(' ', p_name, p_type, min(p_brand), '版本 漏洞')) as x from pool group by p_type, p_name),
q as (select distinct query_id, unnest(list_concat({_WT}, ['版本', '漏洞'])) as t from q0),
bm as (select query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl))) as s from q join df using (t) join tf using (t), st group by 1, 2),
w as (select query_id, sum(coalesce(idf, 0.1)) as whole from q left join df using (t) group by 1), ng as (select query_id, doc_id, sum(idf) / any_value(whole) as s from q join df using (t) join tf using (t) join w using (query_id) group by 1, 2),
al as (select query_id, doc_id, 3.5 as s from q0 join d on contains(q0.x, lower(d.v))),
a as (select query_id, doc_id, f, v, round(0.45 * coalesce(al.s / (al.s + 1), 0) + 0.30 * coalesce(bm.s / (bm.s + 1), 0) + 0.20 * coalesce(ng.s, 0) + case when f = 'p_name' then 0.05 else 0 end, 9) as score
  from bm full join ng using (query_id, doc_id) full join al using (query_id, doc_id) join d using (doc_id)),
r as (select *, row_number() over (partition by query_id, f order by score desc, doc_id) as k from a where score >= 0.08), z as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r where k <= 2),
y as (select * from z where rank <= 5), fc as (select query_id, f, count(*) as n from y group by 1, 2),
fs as (select query_id, string_agg(f, ',' order by n desc, f) as top_fields from fc group by 1), ss as (select query_id, count(*) as candidates, round(max(score), 5) as max_score from y group by 1)
select query_id, f as field_name, v as value, round(score, 5) as score, rank, candidates, max_score, top_fields from y join ss using (query_id) join fs using (query_id)
"""


def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of segments: for each brand the values of its types and names, and the field list."""
    part = table(spark, sf_dir, "part")
    groups = part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set("p_name")).alias("names"))
    own = F.array(F.struct(F.lit("p_type").alias("field_name"), F.lit("类型").alias("label"), F.col("types").alias("values")), F.struct(F.lit("p_name").alias("field_name"), F.lit("名称").alias("label"), F.col("names").alias("values")))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("label"), F.lit(p).alias("protected"), F.lit(i).alias("identifier")) for f, t, p, i in (("p_type", "类型", False, False), ("p_name", "名称", True, True), ("p_brand", "品牌", False, True))])
    return groups.select("p_brand", F.sha2(render.segment_prompt(F.lit("output"), own, F.col("p_brand")), 256).alias("segment"), F.sha2(render.candidate_section(own), 256).alias("candidates"), render.policy_section(fields).alias("policy"))


PROMPTS = """
with g as (select p_brand, list_sort(list(distinct p_type)) as t, list_sort(list(distinct p_name)) as n from part group by 1)
select p_brand, sha256(array_to_string(['【文本类型】', '模型输出', '', '【允许使用的候选值】', '- p_type（类型）：' || array_to_string(t, '、'), '- p_name（名称）：' || array_to_string(n, '、'), '', '【待分析文本】', p_brand, '', '请只抽取待分析文本中真实表达的锚点。'], chr(10))) as segment,
  sha256(chr(10) || '【p_type】(类型)' || chr(10) || array_to_string(list_transform(range(1, len(t) + 1), lambda i: '  ' || i || '. ' || t[i]), chr(10)) || chr(10) || chr(10) || '【p_name】(名称)' || chr(10) || array_to_string(list_transform(range(1, len(n) + 1), lambda i: '  ' || i || '. ' || n[i]), chr(10))) as candidates,
  array_to_string(['字段列表：', '  - p_type (类型) ', '  - p_name (名称) 【受限】', '  - p_brand (品牌) 【标识】'], chr(10)) as policy from g
"""


def browse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an administrator sees them: searched over the whole row, names masked."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("category"), "p_name", "p_type")
    return kb.filter_facts(rows, "GEAR", mask=["p_name"])


BROWSE = "select p_partkey, p_brand as category, '••••••' as p_name, p_type from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'gear')"


def anchor_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as anchors of users: the best of each value, and normalised ones that add a value."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.lit("input").alias("source"), F.lit("kind").alias("field_name"), F.col("event_type").alias("canonical"), F.coalesce("props", F.lit("")).alias("text"), F.col("event_id").cast("int").alias("start"), F.col("event_id").cast("int").alias("end"),
        F.when(F.col("event_id") % 3 == 0, "exact").when(F.col("event_id") % 3 == 1, "semantic").otherwise("ambiguous").alias("match_type"), (F.col("event_id") % 5 / 5).alias("confidence"), F.lit(False).alias("inferred"),
    )
    best = match.collapse(rows, ["user_id"])
    more = rows.withColumn("canonical", F.when(F.col("start") % 2 == 0, F.lit("other")).otherwise(F.col("canonical"))).filter("start % 7 = 0")
    return match.add_normalized(best, more, ["user_id"]).groupBy("user_id", "canonical").agg(F.max("confidence").alias("confidence"), F.max("match_type").alias("match_type"), F.count("*").alias("n")).withColumn("confidence", F.when(F.col("canonical") != "other", F.col("confidence"))).withColumn("match_type", F.when(F.col("canonical") != "other", F.col("match_type")))


COLLAPSE = """
with e as (select *, case event_id % 3 when 0 then 'exact' when 1 then 'semantic' else 'ambiguous' end as m, case event_id % 3 when 0 then 6 when 1 then 4 else 1 end as p, event_id % 5 / 5.0 as c from events),
b as (select *, row_number() over (partition by user_id, event_type order by p desc, c desc, length(coalesce(props, '')) desc, event_id) as n from e),
o as (select distinct user_id from events where event_id % 7 = 0 and event_id % 2 = 0)
select user_id, event_type as canonical, cast(c as double) as confidence, m as match_type, 1 as n from b where n = 1 union all select user_id, 'other', null, null, 1 from o
"""


def public_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses: raw answers leave only where a response isn't sensitive."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("turn_id"), F.coalesce("props", F.lit("")).alias("raw_answer"), F.lit("a").alias("answer"), F.when(F.col("value") > 50, "HIGH").otherwise("NONE").alias("risk_level"), (F.col("value") > 50).cast("int").alias("findings"),
        F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "click", None).otherwise(False).alias("sensitive_response"),
    )
    return respond.public(rows).select("turn_id", F.get_json_object("response", "$.raw_answer").alias("raw_answer"), F.get_json_object("response", "$.risk_detected").alias("risk_detected"), F.get_json_object("response", "$.risk_level").alias("risk_level"))


PUBLIC = """
select event_id as turn_id, case when event_type not in ('error', 'click') then coalesce(props, '') end as raw_answer, case when value > 50 then 'true' else 'false' end as risk_detected, case when value > 50 then 'HIGH' else 'NONE' end as risk_level from events
"""


def chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = convert.chunks(table(spark, sf_dir, "events").select("event_id"), "event_id", 300)
    return rows.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("records"), F.min("event_id").alias("first"))


CHUNKS = "select (n - 1) // 300 as chunk, count(*) as records, min(event_id) as first from (select event_id, row_number() over (order by event_id) as n from events) group by 1"

QUERIES = {f.__name__: f for f in (
    intents, answer_strategies, normalized_values, component_matches, import_report, kb_listing, kb_conversion, kb_selection, kb_catalog, local_matches, sanitized_knowledge, payload_guard, generated_answers, last_payloads, trace_spans,
    semantic_conversion, field_retrieval, prompt_sections, browse_facts, anchor_collapse, public_responses, chunked_records,
)}
SQL = {
    "intents": _intents_sql(), "answer_strategies": STRATEGIES, "normalized_values": NORMALIZED, "component_matches": COMPONENTS, "import_report": IMPORT_REPORT, "kb_listing": KB_LISTING, "kb_conversion": KB_CONVERSION,
    "kb_selection": KB_SELECTION, "kb_catalog": KB_CATALOG, "local_matches": LOCAL_MATCHES, "sanitized_knowledge": SANITIZED, "payload_guard": PAYLOAD_GUARD, "generated_answers": GENERATED, "last_payloads": LAST_PAYLOADS,
    "trace_spans": TRACE_SPANS, "semantic_conversion": SEMANTIC, "field_retrieval": FIELD_RETRIEVAL, "prompt_sections": PROMPTS, "browse_facts": BROWSE, "anchor_collapse": COLLAPSE, "public_responses": PUBLIC, "chunked_records": CHUNKS,
}
