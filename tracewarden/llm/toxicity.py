"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training documents, whatever their labels, is the
unlabelled set. A logistic model in numpy minimises the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

stepping back up whenever the second term turns negative (the non-negative estimator). Its output is a calibrated
probability, since the prior is the share of toxic rows among the labelled training rows.

Features are the presence of words and of word beginnings of 4, 5 and 6 bytes (words: lower-cased runs of ASCII
letters, digits and non-ASCII characters); the ``max_features`` that the positives have most beyond the unlabelled are kept.

``max_positives`` and ``max_unlabelled`` bound the sample the model is fitted on (taken by a seeded hash of the id);
scoring covers every whole text. Labels, languages, sources and ids are never features.

Edge cases: null and empty texts have no features and get the score of that; null ids are never training rows; a
label row that repeats counts once, as does an id that repeats (its least text); without positives every score is the prior (0 when unknown).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pick, tagged, untagged
from .textnp import U64, pieces

LEAST_Z = 5.0  # features must differ by this many standard errors: there are very many to choose from
LEAST_LIFT = 3.0  # and be this much more frequent among the positives
MAX_POSITIVES, MAX_UNLABELLED, MAX_FEATURES = 8_000, 12_000, 512
BEGINNINGS = (4, 5, 6)
HELD_OUT = 2


def features(column: pa.Array):
    """For every piece of a text column: (piece, document, hash) of words and word beginnings."""
    for piece in pieces(column, "alnum"):
        doc = piece.documents()
        docs, hashes = [doc], [piece.words]
        for n in BEGINNINGS:
            long = piece.end - piece.start > n
            docs.append(doc[long])
            hashes.append(piece.spans(piece.start[long], piece.start[long] + n) ^ U64(n))
        yield piece, np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Model:
    table: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for piece, doc, hashes in features(column):
            total = np.full(len(piece), self.bias)
            if len(self.table):
                at = np.searchsorted(self.table, hashes)
                at[at == len(self.table)] = 0
                hit = self.table[at] == hashes
                found = np.unique(doc[hit] * len(self.table) + at[hit])  # presence: once for each document
                total += np.bincount(found // len(self.table), self.weights[found % len(self.table)], len(piece))
            out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model that minimises the non-negative risk (Adam, full batches)."""
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)]).astype(np.float32)
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)]).astype(np.float32)
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        # Logistic loss: loss(+) = log(1 + e^-f), loss(-) = log(1 + e^f).
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        g = -g_negative if negative < 0 else prior * (p.T @ -sigmoid(-fp)) / len(p) + g_negative
        g[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    base = pick(docs, doc_id=id_col, text=text_col).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = pick(labels, doc_id=label_id_col, toxic=label_col).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    draw = F.xxhash64(F.lit(seed), "doc_id")
    positive = known.filter("toxic = 1").orderBy(draw).limit(max_positives).select("doc_id", F.lit(True).alias("positive"))
    unlabelled = base.select("doc_id").distinct().orderBy(draw).limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # At most max_positives + max_unlabelled ids: their size is bounded by parameters, whatever the corpus.
    sample = F.broadcast(positive.unionByName(unlabelled))
    # An id that repeats brings one text, so the rows are bounded as the ids are.
    once = base.join(sample, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = cut(once.select("positive", "text").dropDuplicates().repartition(16), "toxicity-sample")
    sizes = dict(rows.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    none = Model(np.zeros(0, U64), np.zeros(0), float(np.log(prior / (1 - prior))) if prior and prior < 1 else (30.0 if prior else -30.0))
    if not n_p or not n_u or not prior or prior >= 1:
        return none

    def presence(batches):
        for batch in batches:
            positive = batch.column("positive").to_numpy(zero_copy_only=False)
            for piece, doc, hashes in features(batch.column("text")):
                pairs = np.unique(np.stack([doc.astype(U64), hashes]), axis=1)
                marks = positive[piece.first + pairs[0].astype(np.int64)]
                h, at = np.unique(pairs[1], return_inverse=True)
                n = np.bincount(at, marks, len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.bincount(at, minlength=len(h)) - n)], names=["hash", "p", "u"])

    counts = rows.mapInArrow(presence, "hash long, p long, u long").groupBy("hash").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    gap = F.col("p") / n_p - F.col("u") / n_u
    z = F.abs(gap) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    best = counts.filter((F.col("p") >= 3) & (F.col("p") / n_p >= LEAST_LIFT * F.col("u") / n_u)).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "hash").limit(max_features).select("hash").collect()
    table = np.sort(np.array([x[0] for x in best], np.int64).view(U64))
    if not len(table):
        return none

    def matrix(batches):
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(table)), bool)
            for piece, doc, hashes in features(batch.column("text")):
                at = np.searchsorted(table, hashes)
                at[at == len(table)] = 0
                hit = table[at] == hashes
                bits[piece.first + doc[hit], at[hit]] = True
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["positive", "bits"])

    packed = sorted((p, bytes(b)) for p, b in rows.mapInArrow(matrix, "positive boolean, bits binary").collect())  # bounded by the sample
    side = lambda positive: np.unpackbits(np.frombuffer(b"".join(b for p, b in packed if p == positive), np.uint8).reshape(-1, -(-len(table) // 8)), axis=1)[:, : len(table)].astype(np.float32)
    weights, bias = fit_nnpu(side(True), side(False), prior)
    return Model(table, weights.astype(float), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[tuple[str, str]]]:
    """All rows under safe names with a column ``score``; restore them with ``untagged``."""
    rows, names = tagged(docs, key_text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[rows.schema[safe] for safe, _ in names], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(safe) for safe, _ in names], pa.array(held.value.score(batch.column("key_text")))], names=schema.names)

    return rows.mapInArrow(run, schema), names


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    found, names = score(docs, train(docs, labels, **options), options.get("text_col", "text"))
    return untagged(found.filter(F.col("score") < threshold), names)
