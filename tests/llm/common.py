"""Odd documents, and brute-force pieces that the tests share."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCAB = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[50] = "changed"
    passage = words(rng, 60)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(near), "de", "b", None), (4, None, None, None, None), (5, "", "en", "c", 0), (6, " \n\t ", "en", "c", 3),
        (7, "two words", "en", "b", 9), (8, "Two  WORDS", "en", "b", 10), (None, base, "en", "a", 1), (None, "own text of a row without id " + words(rng, 80), None, "a", 1), (9, "dup row " + words(rng, 70), "fr", None, 1),
        (9, "dup row " + words(rng, 70), "fr", None, 1), (10, words(rng, 40) + " " + passage + " " + words(rng, 30), "en", "d", 1), (11, passage + " " + words(rng, 50), "en", "d", 1), (12, words(rng, 6000), "en", "e", 1), (13, "same " * 3000, "en", "e", 1),
        (14, "é😀 ünï " * 40, "fr", "é", 1),
    ]
    rows.append(rows[10])  # a repeated row
    return rows + [(100 + i, words(rng, 60), "en", "a", i) for i in range(30)]


def odd(spark, rows=None, extra=True):
    """The odd documents, with extra columns whose names clash with results and differ only in case."""
    frame = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    if extra:
        for name in ("score", "size", "shard", "n_words", "node", "key", "copies", "TEXT"):
            frame = frame.toDF(*frame.columns).selectExpr("*", f"'x' as `{name}`") if name != "TEXT" else frame.select("*", frame["lang"].alias("TEXT"))
    return frame


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", lowered(text))


def shingles(text, k):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
