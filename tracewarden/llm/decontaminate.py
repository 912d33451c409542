"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. With k-grams of 5 words and
winnowing windows of 6 k-grams, every shared span of 10 words has its window minimum among the fingerprints of both
sides, so no span of that length is missed. Fingerprints of documents are joined with those of the benchmark; each
hit is extended to the 10-word windows that hold it, which are compared whole. Items of 1 to 9 words are one window
each and are looked up by that length (winnowing promises nothing for them).

The benchmark is indexed in blocks of at most ``block_bytes`` of item text, each broadcast by itself; a larger
benchmark takes more blocks, never a larger broadcast, and documents pass block after block without a shuffle.

Edge cases: null or empty texts have no words and no hits; null item texts are no items; words of an item with a
null id are hit, but no id is listed; equal item ids count once; repeated rows are judged alike; an empty benchmark
contaminates nothing. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pick, tagged, untagged
from .textnp import U64, ngrams, pieces

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
REPORT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.BinaryType()),
])


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Index:
    """Fingerprints, whole windows and short items of one block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        prints, owners = [], {}  # owners: words -> [(hash, item)]
        texts = pa.array([t or "" for _, t in items], pa.string())
        for piece in pieces(texts, "alnum"):
            for i in range(len(piece)):
                words = piece.words[piece.bounds[i] : piece.bounds[i + 1]]
                size = min(window, len(words))
                if size:
                    owners.setdefault(size, []).extend((h, piece.first + i) for h in set(ngrams(words, size).tolist()))
                if size == window:
                    prints.append(minima(ngrams(words, gram), window - gram + 1))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.names = [None if x is None else str(x) for x, _ in items]
        self.tables = {}
        for size, pairs in owners.items():
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], U64)
            unique, first = np.unique(hashes, return_index=True)
            self.tables[size] = (unique, np.append(first, len(hashes)), np.array([i for _, i in pairs]))

    def hits(self, words: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words in a window, starts, positions in that table) of windows in a piece that the block has."""
        found = []
        for size, (table, _, _) in self.tables.items():
            n = len(words) - size + 1
            if n <= 0:
                continue
            if size == self.window:
                low = minima(ngrams(words, self.gram), size - self.gram + 1)
                turn = np.empty(n, bool)  # a winnowing window whose fingerprint is not that of the one before
                turn[0] = True
                np.not_equal(low[1:], low[:-1], out=turn[1:])
                hit = member(low[turn], self.prints)[np.cumsum(turn) - 1]
                starts = np.flatnonzero(hit & (doc[:n] == doc[size - 1 :]))
                if not len(starts):
                    continue
                whole = words[starts[:, None] + np.arange(size)].reshape(-1)
                hashes = ngrams(whole, size)[::size]
            else:
                starts = np.flatnonzero(doc[:n] == doc[size - 1 :])
                hashes = ngrams(words, size)[starts]
            ok = member(hashes, table)
            if ok.any():
                found.append((size, starts[ok], np.searchsorted(table, hashes[ok])))
        return found


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, set]]:
    """For every text: word count, hit words (bool for each), ids of items; None stands for no hits."""
    for piece in pieces(column, "alnum"):
        counts = np.diff(piece.bounds)
        doc = np.repeat(np.arange(len(piece)), counts)
        cover, ids = None, {}
        for size, starts, at in index.hits(piece.words, doc):
            if cover is None:
                cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            _, first, owner = index.tables[size]
            for d, k in set(zip(doc[starts].tolist(), at.tolist())):
                ids.setdefault(d, set()).update(index.names[i] for i in owner[first[k] : first[k + 1]].tolist())
        marks = None if cover is None else np.cumsum(cover[:-1]) > 0
        for d in range(len(piece)):
            yield int(counts[d]), (marks[piece.bounds[d] : piece.bounds[d + 1]] if d in ids else None), ids.get(d, set()) - {None}


def _pass(df: DataFrame, index, keep: list[str]) -> DataFrame:
    """One block of the benchmark over all documents; merges with the report that earlier blocks left."""
    schema = T.StructType([df.schema[c] for c in keep] + REPORT.fields)

    def run(batches):
        block = index.value
        for batch in batches:
            had = "spans" in batch.schema.names
            old_items = batch.column("items") if had else None
            n_words, n_hit, items, spans = [], [], [], []
            for i, (n, marks, ids) in enumerate(_scan(batch.column("probe"), block)):
                packed = old_bits = None
                if had and (old_bits := batch.column("spans")[i].as_py()) is not None:
                    old = np.unpackbits(np.frombuffer(old_bits, np.uint8), count=n).astype(bool)
                    marks = old if marks is None else marks | old
                    ids = ids | set(old_items[i].as_py())
                if marks is not None:
                    packed = np.packbits(marks).tobytes()
                n_words.append(n)
                n_hit.append(0 if marks is None else int(marks.sum()))
                items.append(sorted(ids))
                spans.append(packed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.binary())],
                names=keep + REPORT.names,
            )

    return df.mapInArrow(run, schema)


def scan(docs: DataFrame, bench: DataFrame, carry: list[str], window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (texts in column ``probe``) with the columns ``carry`` and n_words, n_hit, items, spans (bits of hit words)."""
    spark = docs.sparkSession
    bench = bench.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        block = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Index([tuple(x) for x in block.collect()], window, gram))
        last = k == blocks - 1
        docs = _pass(docs, index, carry if last else list(dict.fromkeys([*carry, "probe"])))
        if not last:
            docs = cut(docs, f"decontaminate-{k}")
    return docs


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated): items are the ids found, sorted as strings."""
    base = pick(docs, doc_id=id_col, probe=text_col)
    found = scan(base, pick(bench, item_id=item_col, text=item_text_col), ["doc_id"], **options)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, bench: DataFrame, max_hit_words: int = 0, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with at most ``max_hit_words`` words of the benchmark, in their own columns."""
    rows, names = tagged(docs, probe=text_col)
    found = scan(rows, pick(bench, item_id=item_col, text=item_text_col), [safe for safe, _ in names], **options)
    return untagged(found.filter(F.col("n_hit") <= max_hit_words), names)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
