"""Hybrid retrieval over an inverted index: BM25, weighted overlap, alias hits and field hints, fused and cut."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash
from .match import containing, contains_join, weak_value

# Fixed values.
K1, B, UNSEEN_IDF, MIN_SCORE, PER_FIELD, TOP = 1.2, 0.75, 0.1, 0.08, 8, 40
FUSION = {"alias": 0.45, "bm25": 0.30, "ngram": 0.20, "hint": 0.05}
ALIAS_POINTS = {"canonical": 3.5, "alias": 3.0, "component": 2.0, "clue": 1.0}
ALIAS_MARKS = {"canonical": "cv", "alias": "alias", "component": "comp", "clue": "clue"}
# Queries are held in memory up to so many rows and words; (query, document) cells that are scored at once; by how much scores may differ before they are rounded.
HELD_QUERIES, HELD_WORDS, CELLS, CLOSE = 20_000, 2_000_000, 1 << 20, 2e-9
# Arrow batches of documents' words: a batch is in memory several times, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2097152", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
# Words that hint at a field.
FIELD_HINTS = {
    "medication": ["用药", "治疗", "处方", "药物", "双抗", "抗血小板", "beta受体阻滞剂", "替格瑞洛", "阿司匹林", "华法林"],
    "diagnosis": ["诊断", "病情", "疾病", "心梗", "脑卒中", "冠心病", "心房颤动", "心衰", "肿瘤", "骨折"],
    "insurance_level": ["医保", "报销", "自费", "城镇职工", "城镇居民", "商业保险"],
    "ward_type": ["病房", "icu", "ccu", "重症", "特需", "普通病房"],
    "department": ["科室", "心内科", "神经内科", "外科", "肿瘤科", "骨科"],
    "condition_summary": ["心梗", "胸痛", "心悸", "脑卒中", "化疗", "骨折", "心衰", "肿瘤"],
    "patient_name": ["患者", "病人", "病例"],
    "loan_amount": ["金额", "贷款", "万元", "亿元", "人民币"],
    "interest_rate": ["利率", "lpr", "bp", "年化"],
    "credit_rating": ["评级", "信用", "aa", "bbb", "a级", "b级"],
    "collateral": ["抵押", "担保", "质押", "研发大楼", "晶圆产线"],
    "company_name": ["公司", "企业", "有限", "科技", "新能源", "数据服务"],
    "industry": ["行业", "半导体", "光伏", "医疗", "数据中心", "房地产", "装备制造"],
    "loan_type": ["贷款", "流动资金", "项目", "固定资产", "并购", "技改"],
    "branch": ["分行", "上海", "杭州", "深圳", "南京"],
    "component_version": ["版本", "组件", "cve", "漏洞", "xz", "utils", "5.6"],
    "risk_status": ["风险", "高危", "暴露", "远程代码执行", "恶意代码"],
    "disposition_status": ["处置", "修复", "回滚", "未完成", "已完成", "已隔离"],
    "remote_entry": ["入口", "ssh", "运维", "远程"],
    "system_name": ["系统", "平台", "服务", "链路"],
    "function_category": ["监测", "链路", "健康"],
    "meeting_topic": ["会议", "议题", "主题"],
    "meeting_type": ["闭门", "评审", "谈判", "验收", "例会", "复查"],
    "room": ["会议室", "b-307", "a-306", "c-201", "d-101"],
    "time_slot": ["周四", "周五", "周三", "上午", "下午", "15:30", "16:00"],
    "participants": ["供应商", "乙方", "合作方", "内部", "员工"],
    "material_count": ["材料", "份"],
    "restricted_content": ["纪要", "内容", "涉密"],
    "confidential": ["涉密", "机密", "保密", "true"],
}


def index(docs: DataFrame, tokens: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Postings (key, token, tf, doc_len) and token statistics (token, idf); one shuffle by (key, token), one by token."""
    rows = docs.select(key, tokens.alias("tokens")).select(key, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("token"))
    postings = rows.groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    total = docs.count()
    stats = postings.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return postings, stats


def average_length(docs: DataFrame, tokens: Column) -> float:
    return docs.agg(F.avg(F.size(tokens))).first()[0] or 1.0


def bm25(queries: DataFrame, postings: DataFrame, stats: DataFrame, avgdl: float, query_key: str, key: str) -> DataFrame:
    """(query_key, key, bm25) of documents that share a token; ``queries`` has distinct (query_key, token)."""
    weighed = queries.join(F.broadcast(stats) if stats.limit(100_001).count() <= 100_000 else stats, "token")
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("doc_len") / F.lit(avgdl))
    return weighed.join(postings, "token").groupBy(query_key, key).agg(F.sum(F.col("idf") * tf * (K1 + 1) / (tf + norm)).alias("bm25"))


def overlap(queries: DataFrame, postings: DataFrame, stats: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, ngram): share of a query's token weight that a document has; unseen tokens weigh 0.1."""
    weighed = queries.join(stats, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(UNSEEN_IDF)))
    whole = weighed.groupBy(query_key).agg(F.sum("idf").alias("whole"))
    shared = weighed.join(postings.select(key, "token"), "token").groupBy(query_key, key).agg(F.sum("idf").alias("shared"))
    return shared.join(whole, query_key).select(query_key, key, (F.col("shared") / F.col("whole")).alias("ngram"))


def merged_words(docs: DataFrame, words: Column, key: str, field: str, again: DataFrame | None) -> DataFrame:
    """(key, words, doc_len, fields): rows whose key is in ``again`` are one document, as in ``index``, with a run of words and a field of each row."""
    rows = docs.select(key, words.alias("words"), field).withColumn("doc_len", F.size("words"))
    single = lambda df: df.select(key, F.array("words").alias("words"), "doc_len", F.array(field).alias("fields"))
    if again is None:
        return single(rows)
    same = F.col(key).eqNullSafe(F.col("_again"))
    many = rows.join(again, same, "left_semi").groupBy(key).agg(F.collect_list("words").alias("words"), F.first("doc_len").alias("doc_len"), F.collect_list(field).alias("fields"))
    return single(rows.join(again, same, "left_anti")).unionByName(many)


class Held:
    """The words and word pairs of queries, with numbers: looked up in the documents' words without any join."""

    def __init__(self, queries: list[list[str]]):
        self.n = len(queries)
        self.words = list(dict.fromkeys(w for q in queries for w in q))
        number = {w: i for i, w in enumerate(self.words)}
        ids = [[number[w] for w in q] for q in queries]
        size = max(1, len(self.words))
        pairs = [sorted({a * size + b for a, b in zip(q, q[1:])}) for q in ids]
        self.codes = np.array(sorted({c for p in pairs for c in p}), np.int64)
        self.of_word = self._lists([(w, q) for q, own in enumerate(ids) for w in set(own)], len(self.words))
        self.of_pair = self._lists([(c, q) for q, own in enumerate(pairs) for c in np.searchsorted(self.codes, own).tolist()], len(self.codes))

    @staticmethod
    def _lists(rows: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The queries of each token: bounds, and the queries in the order of tokens."""
        rows = np.array(sorted(rows), np.int64).reshape(-1, 2)
        return np.searchsorted(rows[:, 0], np.arange(n + 1)), rows[:, 1]

    def postings(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(document, word, count) and (document, pair) of the queries' tokens in an array of documents' runs of words."""
        runs, per = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
        sizes = runs.value_lengths().fill_null(0).to_numpy()
        ids = pc.index_in(runs.flatten(), value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        run = np.repeat(np.arange(len(sizes)), sizes)
        doc = np.repeat(np.arange(len(per)), per)[run]
        size = max(1, len(self.words))
        hit = ids >= 0
        cells, counts = np.unique(doc[hit] * size + ids[hit], return_counts=True)
        both = np.flatnonzero(hit[:-1] & hit[1:] & (run[:-1] == run[1:]))
        code = ids[both] * size + ids[both + 1]
        place = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[place] == code if len(self.codes) else np.zeros(len(code), bool)
        pairs = np.unique(doc[both[known]] * max(1, len(self.codes)) + place[known])
        return cells // size, cells % size, counts, pairs // max(1, len(self.codes)), pairs % max(1, len(self.codes))


def _added(lists: tuple[np.ndarray, np.ndarray], token: np.ndarray, doc: np.ndarray, points: np.ndarray, lo: int, hi: int, docs: int) -> np.ndarray:
    """Sums of points for queries lo to hi and all documents of a batch: a cell for each, queries first."""
    bounds, queries = lists
    n = bounds[token + 1] - bounds[token]
    at = np.repeat(bounds[token] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    query, here, points = queries[at], np.repeat(doc, n), np.repeat(points, n)
    own = (query >= lo) & (query < hi)
    return np.bincount((query[own] - lo) * docs + here[own], points[own], (hi - lo) * docs)


def _trim() -> None:
    """A worker goes on to other tasks: freed memory is given back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't trim
        ctypes.CDLL(None).malloc_trim(0)


def held_scores(docs: DataFrame, queries: DataFrame, terms: DataFrame, words: Column, query_key: str, key: str, field: str, per_field: int = PER_FIELD) -> DataFrame | None:
    """(query_key, key, field, bm25, ngram, alias): what can be among the best ``per_field`` documents of a query and field.

    ``docs`` has (key, field, text), ``queries`` (query_key, text), ``terms`` (query_key, kind, term). Two passes over the
    documents' words with the queries held in memory: token statistics, then scores by words and word pairs. Each task
    keeps its own best of every query and field, with all that are too close to tell before rounding, so no posting and
    no other pair is shuffled. Terms only raise a score, so the pairs that have some are scored by themselves: of the
    documents, only those that hold a term are shuffled. What adds the same to a query and field, as a hint does, does not change the choice.
    None where the queries are too many to be held or their keys repeat. Documents without a key only count in the statistics.
    """
    sized = queries.agg(F.count("*"), F.sum(F.size(words)), F.count_distinct(query_key)).first()
    if sized[0] > HELD_QUERIES or (sized[1] or 0) > HELD_WORDS or sized[2] < sized[0]:
        return None
    for name, value in BATCH.items():  # stays set, as the plans run later
        docs.sparkSession.conf.set(name, value)
    asked = queries.select(query_key, words.alias("words")).collect()
    held = Held([r["words"] or [] for r in asked])
    n_words, n_pairs = len(held.words), len(held.codes)
    again = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"))
    again = None if again.isEmpty() else again
    rows = merged_words(docs, words, key, field, again)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_words + n_pairs, np.int64)
        for batch in batches:
            _, word, _, _, pair = held.postings(batch.column("words"))
            df += np.r_[np.bincount(word, minlength=n_words), np.bincount(pair, minlength=n_pairs)].astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["token", "df"])
        _trim()

    df = np.zeros(n_words + n_pairs)
    for token, n in rows.select("words").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df")).collect():
        df[token] = n
    total = docs.count()
    avgdl = average_length(docs, words)
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    weight = np.where(df[n_words:] > 0, idf[n_words:], UNSEEN_IDF)
    bounds, of = held.of_pair
    whole = np.bincount(of, np.repeat(weight, np.diff(bounds)), held.n)
    number = docs.sparkSession.createDataFrame([(r[query_key], i) for i, r in enumerate(asked)], queries.select(query_key, F.lit(0).alias("_query")).schema)
    hits = alias_scores(docs, terms, key, query_key).select(query_key, key, "alias")
    by_doc = hits.join(F.broadcast(number), query_key).groupBy(key).agg(F.collect_list(F.struct("_query", "alias")).alias("hits"))
    holding = rows if again is not None else merged_words(containing(docs, terms), words, key, field, None)

    def best(table: pa.Table) -> pa.Table:
        """The best of each query and field, and what is too close to the last of them."""
        table = table.combine_chunks()
        coded = pc.dictionary_encode(table.column("f"), null_encoding="encode").combine_chunks()
        table = table.append_column("c", (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).indices)
        table = table.take(pc.sort_indices(table, [("q", "ascending"), ("c", "ascending"), ("v", "descending"), ("d", "ascending")]))
        q, c, v = (table.column(x).to_numpy() for x in "qcv")
        first = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])][: len(q)]
        equal = np.r_[True, first[1:] | (v[1:] != v[:-1])][: len(q)]
        here = np.arange(len(q))
        start, level = np.maximum.accumulate(np.where(first, here, 0)), np.maximum.accumulate(np.where(equal, here, 0))
        ends = np.r_[np.flatnonzero(first)[1:], len(q)]
        last = np.minimum(start + per_field - 1, np.repeat(ends, np.diff(np.r_[np.flatnonzero(first), len(q)])) - 1)
        keep = (v >= v[last] - CLOSE) & (here - level < per_field)
        return table.drop_columns(["c"]).filter(pa.array(keep))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            doc, word, tf, doc2, pair = held.postings(batch.column("words"))
            n = batch.num_rows
            norm = K1 * (1 - B + B * batch.column("doc_len").fill_null(0).to_numpy() / avgdl)
            points = idf[word] * tf * (K1 + 1) / (tf + norm[doc])
            of_doc = of_query = np.zeros(0, np.int64)
            alias_of = np.zeros(0)
            if "hits" in batch.schema.names:
                found = batch.column("hits")
                of_doc, told = np.repeat(np.arange(n), found.value_lengths().to_numpy()), found.flatten()
                of_query, alias_of = told.field("_query").to_numpy(), told.field("alias").to_numpy()
            for lo in range(0, held.n, step := max(1, CELLS // max(1, n))):
                hi = min(held.n, lo + step)
                bm = _added(held.of_word, word, doc, points, lo, hi, n)
                at = np.flatnonzero(bm > 0)
                ng = _added(held.of_pair, pair, doc2, weight[pair], lo, hi, n)[at] / np.maximum(whole[lo + at // n], 1e-300)
                alias = np.zeros(len(bm))
                own = (of_query >= lo) & (of_query < hi)
                alias[(of_query[own] - lo) * n + of_doc[own]] = alias_of[own]
                if "hits" in batch.schema.names:
                    ng, at = ng[alias[at] > 0], at[alias[at] > 0]
                bm, alias, d = bm[at], alias[at], pa.array(at % n)
                v = FUSION["bm25"] * squash(bm) + FUSION["ngram"] * ng + FUSION["alias"] * squash(alias)
                new = pa.table({"q": pa.array(lo + at // n), "d": batch.column(key).take(d), "f": batch.column(field).take(d), "bm25": bm, "ngram": ng, "alias": alias, "v": v})
                kept = best(new if kept is None else pa.concat_tables([kept, new]))
        if kept is not None:
            yield from kept.drop_columns(["v"]).select(["q", "d", "f", "bm25", "ngram", "alias"]).to_batches()
        _trim()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def chosen(ready: DataFrame) -> DataFrame:
        told = ready.filter(F.col(key).isNotNull()).withColumn(field, F.explode("fields")).drop("fields")
        out = told.mapInArrow(score, f"q long, d {kinds[key]}, f {kinds[field]}, bm25 double, ngram double, alias double")
        return out.join(F.broadcast(number), F.col("q") == F.col("_query")).select(query_key, F.col("d").alias(key), F.col("f").alias(field), "bm25", "ngram", "alias")

    return chosen(rows).join(hits.select(query_key, key), [query_key, key], "left_anti").unionByName(chosen(holding.join(by_doc, key)))


def alias_points(text: Column, terms: Column) -> Column:
    """Points of an array of (kind, term) whose term the text contains."""
    point = lambda t: F.coalesce(*[F.when(t["kind"] == k, v) for k, v in ALIAS_POINTS.items()], F.lit(0.0))
    return F.aggregate(F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t["term"]))), F.lit(0.0), lambda acc, t: acc + point(t))


def alias_scores(queries: DataFrame, terms: DataFrame, query_key: str, key: str, text: str = "text") -> DataFrame:
    """(query_key, key, alias, matched): points of a document's terms (key, kind, term) that a query contains, and those
    terms with their kind's mark; weak values are to be left out of ``terms``."""
    hits = contains_join(queries.select(query_key, F.col(text).alias("_text")), terms.select(key, "kind", "term"), "_text", "term").select(query_key, key, "kind", "term").distinct()
    point, mark = F.lit(0.0), F.lit("")
    for kind, points in ALIAS_POINTS.items():
        point, mark = F.when(F.col("kind") == kind, points).otherwise(point), F.when(F.col("kind") == kind, ALIAS_MARKS[kind]).otherwise(mark)
    return hits.groupBy(query_key, key).agg(F.sum(point).alias("alias"), F.array_sort(F.collect_list(F.concat(mark, F.lit(":"), F.col("term")))).alias("matched"))


def hint(text: Column, hints: Column) -> Column:
    n = F.size(F.filter(hints, lambda h: F.contains(text, h)))
    return F.when(n >= 2, 1.0).when(n == 1, 0.5).otherwise(0.0)


def field_hint(text: Column, field: Column, table: dict[str, list[str]] | None = None) -> Column:
    """The hint score of a field's words in a normalised text; 0 for fields without words."""
    out = F.lit(0.0)
    for name, words in (table or FIELD_HINTS).items():
        out = F.when(field == name, hint(text, F.array(*map(F.lit, words)))).otherwise(out)
    return out


def candidate_documents(facts_long: DataFrame, labels: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, field_name, value, text, ord): a document for each distinct (field, value) that is not weak, in the order of
    fields, then of the pool.

    Its text joins field, label, value and the value's aliases, components and clues (``terms``: field_name, canonical,
    kind, term, ord). ``facts_long``: (field_name, value, field_rank, position).
    """
    own = facts_long.filter((F.coalesce("value", F.lit("")) != "") & ~weak_value(F.col("field_name"), F.col("value"))).groupBy("field_name", "value").agg(F.min(F.struct("field_rank", "position")).alias("ord"))
    rows = own.join(labels.select("field_name", "label"), "field_name", "left").withColumn("label", F.coalesce("label", "field_name"))
    parts = [F.col("field_name"), F.col("label"), F.col("value")]
    if terms is not None:
        rank = F.when(F.col("kind") == "alias", 0).when(F.col("kind") == "component", 1).otherwise(2)
        told = terms.withColumn("_k", rank).groupBy("field_name", F.col("canonical").alias("value")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ord", "term"))), lambda x: x["term"]), " | ").alias("_told"))
        rows = rows.join(told, ["field_name", "value"], "left")
        parts.append(F.nullif("_told", F.lit("")))
    return rows.select(F.concat_ws("=", "field_name", "value").alias("doc_id"), "field_name", "value", F.concat_ws(" | ", *parts).alias("text"), "ord")


def stats(ranked: DataFrame, query_key: str, field: str = "field_name", score: str = "score") -> DataFrame:
    """(query_key, candidates, max_score, avg_score, top_fields): the fields by how many candidates they have, ten at most."""
    fields = ranked.groupBy(query_key, field).agg(F.count("*").alias("_n"))
    top = fields.groupBy(query_key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), field))), lambda x: x[field]), 1, 10).alias("top_fields"))
    return ranked.groupBy(query_key).agg(F.count("*").alias("candidates"), F.max(score).alias("max_score"), F.avg(score).alias("avg_score")).join(top, query_key)


def grouped_values(ranked: DataFrame, query_key: str, field: str = "field_name", value: str = "value", rank: str = "rank", most: int = 10) -> DataFrame:
    """(query_key, field, values): distinct values of each field in the order of their rank, ``most`` at most."""
    first = ranked.groupBy(query_key, field, value).agg(F.min(rank).alias("_r"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(query_key, field).orderBy("_r", value))).filter(F.col("_n") <= most)
    return kept.groupBy(query_key, field).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def fuse(bm: Column, ngram: Column, alias: Column, hints: Column) -> Column:
    return FUSION["bm25"] * squash(bm) + FUSION["ngram"] * ngram + FUSION["alias"] * squash(alias) + FUSION["hint"] * hints


def cut_top(scored: DataFrame, query_key: str, field: str | None, tie: str, score: str = "score", per_field: int = PER_FIELD, top: int = TOP, least: float = MIN_SCORE) -> DataFrame:
    """Scores of at least ``least``: the best ``per_field`` of a field, then the best ``top`` of a query, as ``rank``."""
    kept = scored.filter(F.col(score) >= least)
    if field:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(query_key, field).orderBy(F.desc(score), tie))).filter(F.col("_r") <= per_field).drop("_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(score), tie))).filter(F.col("rank") <= top)
