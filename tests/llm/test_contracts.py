"""Registered queries against SQL at a small size, and against brute force."""

import hashlib
import zlib

import pytest

from tests.oracle import SF, agree
from tracewarden.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    agree(spark, registry.QUERIES[name], registry.SQL[name])


def test_media(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op2_gif_media"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    again = {r.doc_id: r for r in registry.QUERIES["op2_gif_media"](spark, SF).collect()}
    assert all(again[r.doc_id] == r for r in rows)


def test_shards(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op6_interleaved_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = [[r for r in rows if r.shard == s] for s in range(24)]
    assert max(map(len, by)) - min(map(len, by)) <= 1
    for part in by:
        assert sorted(r.slot for r in part) == list(range(len(part)))
        for source in {d.source for d in docs.values()}:
            n = sum(d.source == source for d in docs.values())
            assert abs(sum(docs[r.doc_id].source == source for r in part) - n / 24) <= 2
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_mix(spark):
    rows = registry.QUERIES["op7_cube_mix"](spark, SF).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    assert all(sizes[source[r.doc_id]] == r.source_size for r in rows)
    want, order, total = {}, sorted(sizes), sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:  # reshare until none is above
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) for s in order)
    assert sum(abs(taken[s] - target[s]) for s in order) < 0.1 * total
    again = {r.doc_id: r.taken for r in registry.QUERIES["op7_cube_mix"](spark, SF).collect()}
    assert all(again[r.doc_id] == r.taken for r in rows)


def test_toxicity_and_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def auc(rows, score, label):
        rows = sorted(rows, key=lambda r: r[score])
        ones = [i for i, r in enumerate(rows) if r[label] == 1]
        return (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(rows) - len(ones)))

    toxic = registry.QUERIES["op9_nnpu_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert auc(toxic, "score", "toxic") > 0.93
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in toxic)
    quality = registry.QUERIES["op1_cotrained_quality"](spark, sf).join(labels, "doc_id").collect()
    assert auc(quality, "score", "quality") > 0.97


def test_passages_hold_every_shared_run(spark):
    from tests.llm.common import spaced

    docs = {r.doc_id: spaced(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id for r in registry.QUERIES["op4_compact_window_passages"](spark, SF).collect()}
    runs: dict = {}
    for key, w in docs.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(key)
    must = set().union(*[v for v in runs.values() if len(v) > 1])
    assert must and must <= found
    pieces: dict = {}
    for key, w in docs.items():
        for i in range(len(w) - 4):
            pieces.setdefault(tuple(w[i : i + 5]), set()).add(key)
    related = set().union(*[v for v in pieces.values() if len(v) > 1])
    assert found <= related


def test_parity_bitmaps_never_rule_out_a_link():
    import numpy as np

    from tracewarden.llm.jaccard import differing, parity

    rng = np.random.default_rng(5)
    for n, m, both in ((1, 1, 1), (1, 3, 1), (40, 47, 38), (200, 231, 190), (60_000, 70_000, 59_000), (5, 900, 0)):
        x = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        a, b = np.sort(x[:n]), np.sort(x[n - both : n - both + m])
        assert differing(parity(a), parity(b)) <= n + m - 2 * both
    assert differing(parity(x[:300]), parity(x[300:600])) > 200
