"""Document quality by co-training two views.

The text view sees byte and word statistics of the whole text; the metadata view sees language, source and size
columns only. Each view is a logistic model in numpy. In every round each view labels the unlabelled pool, and its
most confident rows of both classes become training rows of the *other* view. Afterwards each view is calibrated
(Platt) on a fold neither was trained on, and a small logistic model weighs the two calibrated log-odds; the result
scores every document.

``max_labelled`` and ``max_pool`` bound the rows the models are fitted on (taken by a seeded hash of the id); scoring
covers every whole text.

Edge cases: null texts count as empty; null metadata is a value of its own; missing metadata columns count as null;
null ids are never training rows; with labels of one class only (or none), every score is that class's share (0.5
when unknown).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .textnp import pieces

MAX_LABELLED, MAX_POOL, ROUNDS, CONFIDENT, SHARE = 8_000, 12_000, 4, 0.9, 0.05
META_CELLS = 64
CALIBRATION_FOLD = 1  # of 4, by the CRC-32 of the id


def text_view(column: pa.Array) -> np.ndarray:
    """Square roots of byte shares (128 ASCII bytes, the rest as one), word and line statistics."""
    out = []
    for piece in pieces(column, "space", lower=False):
        for i in range(len(piece)):
            data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
            words = piece.words[piece.bounds[i] : piece.bounds[i + 1]]
            size, n = max(1, len(data)), max(1, len(words))
            counts = np.bincount(np.minimum(data, 128), minlength=129) if len(data) else np.zeros(129)
            upper, lower = counts[65:91].sum(), counts[97:123].sum()
            more = [np.log1p(len(words)), np.log1p(len(data) / n), len(np.unique(words)) / n, upper / max(1, upper + lower), counts[10] / n, counts[48:58].sum() / size]
            out.append(np.concatenate([np.sqrt(counts / size), more]))
    return np.asarray(out, np.float32).reshape(len(out), 135)


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed one-hot language and source, and a log scale of the stated size."""
    out = np.zeros((len(lang), META_CELLS + 12), np.float32)
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(f"lang={a}".encode()) % META_CELLS] = 1
        out[i, zlib.crc32(f"source={b}".encode()) % META_CELLS] = 1
        level = 0.0 if n is None or n < 0 else float(np.log2(n + 1))
        out[i, META_CELLS + min(10, int(level) // 2)] = 1
        out[i, -1] = level / 16
    return out


@dataclass
class Logit:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> Logit:
    """Ridge logistic regression by Newton's method on standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]).astype(np.float64)
    w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * len(x))
    keep[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logit(w, mean, scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    prior: float
    views: list[Logit] = field(default_factory=list)
    platt: list[Logit] = field(default_factory=list)
    blend: Logit | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text, metadata and combined probabilities."""
        if self.blend is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        odds = [p.odds(v.odds(x)[:, None]) for v, p, x in zip(self.views, self.platt, (text, meta))]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(self.blend.odds(np.stack(odds, 1)))


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, confident: float = CONFIDENT, share: float = SHARE) -> Model:
    """``fold`` marks calibration rows; ``pool`` has the views of unlabelled rows."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y[~fold].tolist())) < 2 or len(set(y[fold].tolist())) < 2:
        return Model(prior)
    extra = [np.full(len(pool[0]), -1.0), np.full(len(pool[0]), -1.0)]  # pseudo-labels that each view has been given
    models = [fit_logit(v[~fold], y[~fold]) for v in views]
    for _ in range(rounds if len(pool[0]) else 0):
        for k in (0, 1):
            p = sigmoid(models[k].odds(pool[k]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                # As many of each class as its share allows, the surest first, not yet given to the other view.
                most = max(1, int(share * len(p) * (prior if label else 1 - prior)))
                open_ = np.flatnonzero((sure >= confident) & (extra[1 - k] < 0))
                extra[1 - k][open_[np.argsort(-sure[open_], kind="stable")[:most]]] = label
        models = [fit_logit(np.concatenate([v[~fold], q[e >= 0]]), np.concatenate([y[~fold], e[e >= 0]])) for v, q, e in zip(views, pool, extra)]
    odds = [m.odds(v[fold])[:, None] for m, v in zip(models, views)]
    platt = [fit_logit(o, y[fold], 1e-4) for o in odds]
    blend = fit_logit(np.stack([p.odds(o) for p, o in zip(platt, odds)], 1), y[fold], 1e-3)
    return Model(prior, models, platt, blend)


COLUMNS = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}


def _base(docs: DataFrame) -> DataFrame:
    for name in COLUMNS:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("long" if name in ("doc_id", "n_chars") else "string"))
    return pick(docs, **COLUMNS)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, seed: int = 3, label_col: str = "quality", **options) -> Model:
    base = _base(docs).filter("doc_id is not null")
    known = pick(labels, doc_id="doc_id", y=label_col).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    labelled = known.orderBy(draw).limit(max_labelled)
    pool = base.select("doc_id").distinct().join(known, "doc_id", "left_anti").orderBy(draw).limit(max_pool).select("doc_id", F.lit(-1.0).alias("y"))
    # The sample's ids are bounded by parameters, whatever the corpus.
    fold = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == CALIBRATION_FOLD).alias("fold")
    # An id that repeats brings one row, so what comes to the driver is bounded as the ids are.
    once = base.join(F.broadcast(labelled.unionByName(pool)), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    rows = once.select("doc_id", "y", fold, "r.text", "r.lang", "r.source", "r.n_chars").repartition(16)

    def views(batches):
        for batch in batches:
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            lists = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), pack(text_view(batch.column("text"))), pack(meta_view(*lists))], names=["doc_id", "y", "fold", "t", "m"])

    found = rows.mapInArrow(views, "doc_id long, y double, fold boolean, t binary, m binary").collect()
    found = sorted(found, key=lambda r: r["doc_id"])
    stack = lambda k, some: np.frombuffer(b"".join(bytes(r[k]) for r in some), np.float32).reshape(len(some), -1)
    known_rows, pool_rows = [r for r in found if r["y"] >= 0], [r for r in found if r["y"] < 0]
    if not known_rows:
        return Model(0.5)
    empty = (np.zeros((0, 135), np.float32), np.zeros((0, META_CELLS + 12), np.float32))
    return cotrain((stack("t", known_rows), stack("m", known_rows)), np.array([r["y"] for r in known_rows]), np.array([r["fold"] for r in known_rows]), (stack("t", pool_rows), stack("m", pool_rows)) if pool_rows else empty, **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of every document: probabilities of good quality."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
            out = held.value.scores(text_view(batch.column("text")), meta_view(*lists))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in out]], names=["doc_id", "text_score", "meta_score", "score"])

    return _base(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
