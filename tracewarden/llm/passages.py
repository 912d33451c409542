"""Near-duplicate passages by compact windows.

Each document is a sequence of 5-word shingles. For a hash function, the Cartesian tree over the shingle hashes groups
all subsequences with the same minimum into compact windows: [l, c, r] stands for every subsequence from l..c to c..r.
Of a window that holds a subsequence of ``min_words`` words, the interval of its subsequences of just that length is
kept (found by sliding minima, which give the same windows as the tree). A row (key, node, interval) joins three
signatures that lie in one interval: the window's own minimum, and the minima of ``BESIDE`` further hash functions over
the half passage that ends at it or begins at it, where that half lies inside the interval: a passage always holds one of
the two halves. ``HASHES`` functions anchor keys and one shared key is enough. Equal passages share keys under every
function; a passage of just ``min_words`` words with one word changed, added or left out shares one with probability of
about 0.98 (measured in tests/llm); longer ones meet more keys.

Documents that share a key are candidates. Each is aligned with the list's lead: runs of shared shingles (gaps of up
to ``gap`` words) are kept when they cover ``min_words`` words in both documents and their shingle sets have a Jaccard
similarity of at least ``similarity``; a run that does not is split at its widest gap. A new run also reaches back along
its own diagonal, and equal passages are looked up whole, as the lead may hold their parts in other places too. Documents
that align with the lead where the key's shingles are make one class with it. For the others the list is dealt out once
more with the shingles around the key: all members that share enough of them are compared there in memory, open ones
with settled ones too, until what shares a passage there is one class; only the links that join classes are aligned on
whole texts, fewer than the list has members. Equal word sequences are one node; copies are spelled out in the result only.

A first pass over the corpus finds the keys that two texts have (packed arrays, merged by key); a second one emits the rows of those alone.

Edge cases: null, empty and short texts have no passages; a document's own repetitions are not reported; repeated rows
are copies; null ids count as the largest; an empty table gives no rows. Hashes have 64 bits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, lookup, pick, release, small_batches
from .idfilter import keep_wanted, wanted_cells
from .sharing import shared_keys
from .textnp import U64, mix, ngrams, pieces

SHINGLE, MIN_WORDS, SIMILARITY, GAP = 5, 50, 0.8, 12
HASHES, BESIDE = 4, 2  # hash functions that anchor keys; further minima in a key, from one half of the anchor's interval
LEAST = 0.8  # of the shingles of ``min_words`` words, which members of a list must share around its key to be aligned there
PART_ROWS, LEAST_PARTS = 50_000, 32  # of lists that one task holds in memory
BLOCK, CELLS = 256, 1 << 23  # open members that meet all others at once; cells of a table of members and shingles
SEEDS = [U64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(HASHES)]
PLACE_BITS = 24  # of a hash, when minima are taken with their places; more for a single text of more words


def compact_windows(h: np.ndarray, t: int) -> np.ndarray:
    """Rows (l, c, r) of the Cartesian tree of ``h`` that hold a subsequence of at least t: the definition, for tests."""
    out, todo = [], [(0, len(h))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < t:
            continue
        c = lo + int(h[lo:hi].argmin())
        out.append((lo, c, hi - 1))
        todo += [(lo, c), (c + 1, hi)]
    return np.array(out, np.int64).reshape(-1, 3)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.concatenate([values, np.full(-n % width, ~U64(0), U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each run of ``width`` values."""
    bits = max(PLACE_BITS, len(values).bit_length())
    low = (U64(1) << U64(bits)) - U64(1)
    return (sliding_min(values & ~low | np.arange(len(values), dtype=U64), width) & low).astype(np.int64)


def anchored(values: np.ndarray, starts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, first, last) of the compact windows met by the runs of t values that begin at ``starts``.

    c is the window's minimum; first and last bound the runs of t that hold it as theirs (last: inclusive end).
    """
    c = lowest(values, t)[starts]
    if not len(c):
        return c, c, c
    new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (np.diff(starts) != 1)])
    return c[new], starts[new], starts[np.r_[new[1:], len(c)] - 1] + t - 1


def window_keys(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, t: int) -> np.ndarray:
    """Rows (key, document, start, end) for the shingles ``begin:end`` of each document.

    start and end are the first and last of the key's three shingles, counted from the document's begin.
    """
    long = np.flatnonzero(end - begin >= t)
    edge = np.zeros(len(grams) + 1, np.int64)
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - t + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[:-1])
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    half, rows = t // 2, []
    hashes = [mix(grams ^ seed) for seed in SEEDS]
    near = [lowest(h, half) for h in hashes]
    for f, h in enumerate(hashes):
        c, first, last = anchored(h, starts, t)
        for side, at in enumerate((c - half + 1, c)):
            ok = (at >= first) & (at + half - 1 <= last)
            place, low, high = at[ok], c[ok], c[ok]
            key = h[low] * U64(0x9DDFEA08EB382D69) + U64(2 * f + side)
            for k in range(1, BESIDE + 1):
                beside = near[(f + k) % HASHES][place]
                key = mix(key ^ hashes[(f + k) % HASHES][beside] * U64(0xC2B2AE3D27D4EB4F + 2 * k))
                low, high = np.minimum(low, beside), np.maximum(high, beside)
            # A text of one word has the same key at every place: one row stands for neighbours with one key.
            fresh = np.r_[True, (key[1:] != key[:-1]) | (np.diff(place) != 1)][: len(key)]
            key, place, low, high = key[fresh], place[fresh], low[fresh], high[fresh]
            doc = long[np.searchsorted(begin[long], place, "right") - 1]
            rows.append(np.stack([key.view(np.int64), doc, low - begin[doc], high - begin[doc]], 1))
    return np.concatenate(rows)


def node_hash(words: np.ndarray) -> int | None:
    """64-bit hash of a word sequence."""
    return int(_nodes(words, np.array([0, len(words)]))[0]) if len(words) else None


def _nodes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word sequences between the bounds (without meaning where there are none)."""
    sizes = np.diff(bounds)
    turn = np.arange(len(words)) - np.repeat(bounds[:-1], sizes) + 1
    total = np.r_[U64(0), np.cumsum(mix(words + turn.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), dtype=U64)]
    return mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(U64)).view(np.int64)


def _documents(column: pa.Array):
    """(words, shingles) of each text."""
    for piece in pieces(column, "space"):
        grams = ngrams(piece.words, SHINGLE)
        for lo, hi in zip(piece.bounds.tolist(), piece.bounds.tolist()[1:]):
            yield piece.words[lo:hi], grams[lo : max(lo, hi - SHINGLE + 1)]


def _keyed(column: pa.Array, t: int):
    """(rows of ``window_keys``, nodes of the documents, first document) for every piece of a text column."""
    for piece in pieces(column, "space"):
        begin, end = piece.bounds[:-1], np.maximum(piece.bounds[:-1], piece.bounds[1:] - SHINGLE + 1)
        yield window_keys(ngrams(piece.words, SHINGLE), begin, end, t), _nodes(piece.words, piece.bounds), piece.first


def align(x: np.ndarray, y: np.ndarray, min_words: int, similarity: float, gap: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, start, end, similarity) in words, ends exclusive, that shingle sequences x and y share."""
    order = np.argsort(y, kind="stable")
    sorted_y = y[order]
    lo, hi = np.searchsorted(sorted_y, x, "left"), np.searchsorted(sorted_y, x, "right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return []
    places, spots, froms, tos = order.tolist(), at.tolist(), lo[at].tolist(), hi[at].tolist()

    def exact(i: int, j: int, way: int) -> int:
        """How many shingles from places i and j on are equal in one direction."""
        n, most = 0, min(len(x) - i, len(y) - j) if way > 0 else min(i, j) + 1
        step = 32
        while n < most:
            size = min(step, most - n)
            p, q = (x[i + n : i + n + size], y[j + n : j + n + size]) if way > 0 else (x[i - n - size + 1 : i - n + 1][::-1], y[j - n - size + 1 : j - n + 1][::-1])
            off = p != q
            if off.any():
                return n + int(off.argmax())
            n, step = n + size, 4 * step
        return n

    def chain(i: int, j: int, way: int) -> list[tuple[int, int]]:
        """Ends of the equal stretches that follow place i at place j in one direction: of a shingle's places in y the one nearest to where they lead."""
        run = []
        while True:
            n = way * (exact(i, j, way) - 1)
            i, j = i + n, j + n
            run.append((i, j))
            k = bisect_right(spots, i) if way > 0 else bisect_left(spots, i) - 1
            if not 0 <= k < len(spots):
                return run
            i2, aim = spots[k], j + spots[k] - i
            if abs(i2 - i) > gap:
                return run
            n = bisect_left(places, aim, froms[k], tos[k])
            j2 = min(places[max(n - 1, froms[k]) : min(n + 1, tos[k])], key=lambda v: abs(v - aim))
            if abs(j2 - aim) > gap or (j2 - j) * way <= 0:
                return run
            run.append((i2, j2))
            i, j = i2, j2

    runs, k = [], 0
    while k < len(spots):
        # A run that starts elsewhere in y may have its own beginning where the last run was.
        i, j = spots[k], places[froms[k]]
        ahead, back = chain(i, j, 1), chain(i, j, -1)
        runs.append([*back[::-1], *ahead])  # first and last place of each equal stretch
        k = bisect_right(spots, ahead[-1][0])
    out, todo = [], runs
    while todo:
        run = todo.pop()
        (i0, j0), (i1, j1) = run[0], run[-1]
        if min(i1 - i0, j1 - j0) + SHINGLE < min_words:
            continue
        sx, sy = np.unique(x[i0 : i1 + 1]), np.unique(y[j0 : j1 + 1])
        both = len(np.intersect1d(sx, sy, assume_unique=True))
        score = both / (len(sx) + len(sy) - both)
        if score >= similarity:
            out.append((i0, i1 + SHINGLE, j0, j1 + SHINGLE, score))
        elif len(run) > 2:
            wide = max(range(2, len(run), 2), key=lambda k: max(run[k][0] - run[k - 1][0], run[k][1] - run[k - 1][1]))
            todo += [run[:wide], run[wide:]]
    return sorted({*out, *_exact(x, y, at, out, min_words)})


def _exact(x: np.ndarray, y: np.ndarray, at: np.ndarray, known: list, min_words: int) -> list[tuple[int, int, int, int, float]]:
    """Equal passages of ``min_words`` words that no known one holds, wherever y has their parts besides."""
    t, out = min_words - SHINGLE + 1, []
    held = lambda i, end: any(s[0] <= i and end <= s[1] for s in [*known, *out])
    if not any(len(part) >= t and not held(part[0], part[-1] + SHINGLE) for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)):
        return []
    wx, wy = ngrams(x, t), ngrams(y, t)
    order = np.argsort(wy, kind="stable")
    place = np.searchsorted(wy[order], wx)
    for i in np.flatnonzero(place < np.searchsorted(wy[order], wx, "right")).tolist():
        if held(i, i + min_words):
            continue
        j = int(order[place[i]])
        ahead, back = x[i : i + len(y) - j] != y[j : j + len(x) - i], x[max(0, i - j) : i][::-1] != y[max(0, j - i) : j][::-1]
        after, before = (int(d.argmax()) if d.any() else len(d) for d in (ahead, back))
        if after >= t:
            out.append((i - before, i + after - 1 + SHINGLE, j - before, j + after - 1 + SHINGLE, 1.0))
    return out


def around_key(start: np.ndarray, end: np.ndarray, size: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the shingles of all runs of t that hold a key's shingles start to end, in documents of so many shingles."""
    return np.maximum(0, end - t + 1), np.minimum(size, start + t)


def bridges(node: np.ndarray, start: np.ndarray, end: np.ndarray, near: list[bytes], open_: np.ndarray, min_words: int, similarity: float, gap: int) -> list[dict]:
    """Passages around one key that join its members to classes; those not ``open_`` are one class from the start.

    ``near`` has the shingles that ``around_key`` bounds (32 bits each). Members meet in the order of the shingles they share, most
    first, until no two classes are left of which two members share a passage there; members that share less than
    ``LEAST`` of its shingles cannot. An open member that joins none has a row without a passage, for the one it is most
    like: their whole texts may still align, where only the surroundings of this key differ more.
    """
    t = min_words - SHINGLE + 1
    texts = [np.frombuffer(x, np.uint32).astype(U64) for x in near]
    label = np.where(open_, np.arange(len(node)), -1)
    lead, out, failed, linked, best = node.min(), [], set(), set(), {}
    low = np.maximum(0, end - t + 1)
    first, last = start - low, end - low
    for x, y, span in _overlaps(texts, node, first, last, open_, lead, t, similarity, gap, label):
        if label[x] == label[y]:
            continue
        for k, other in ((x, y), (y, x)):
            if open_[k]:
                best.setdefault(k, other)
        if span is None and (near[x], near[y]) not in failed:
            spans = align(texts[x], texts[y], min_words, similarity, gap)
            held = [s for s in spans if s[0] <= first[x] and last[x] < s[1] and s[2] <= first[y] and last[y] < s[3]]
            span = max(held, key=lambda s: (s[1] - s[0], s[4]), default=None)
            if not span:
                failed.add((near[x], near[y]))
        if not span:
            continue
        label[label == label[y]] = label[x]
        linked |= {x, y}
        out.append({"node": int(node[x]), "lead": int(node[y]), "start": int(span[0] + low[x]), "end": int(span[1] + low[x]), "lead_start": int(span[2] + low[y]), "lead_end": int(span[3] + low[y]), "similarity": float(span[4]), "first": int(start[x]), "last": int(end[x])})
    pairs = {(max(a, b), min(a, b)) for a, b in ((int(node[k]), int(node[other])) for k, other in best.items() if k not in linked)}
    return out + [{"node": a, "lead": b} for a, b in sorted(pairs)]


def _overlaps(texts: list[np.ndarray], node: np.ndarray, first: np.ndarray, last: np.ndarray, open_: np.ndarray, lead: int, t: int, similarity: float, gap: int, label: np.ndarray):
    """(x, y, passage) of pairs of different nodes, but not of the lead, one of them open, that share at least ``LEAST`` of
    t shingles and have not one label by then, most first in each block; x has the greater node. The passage is that of
    ``_around_all``, empty if there is none, and None for texts that it cannot compare.
    """
    least = LEAST * t
    sizes = np.array([len(x) for x in texts])
    who, values = np.repeat(np.arange(len(texts)), sizes), np.concatenate(texts)
    # A shingle's repetitions count as many.
    order = np.lexsort((values, who))
    who, values = who[order], values[order]
    fresh = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (values[1:] != values[:-1])])
    turn = np.arange(len(values)) - np.repeat(fresh, np.diff(np.r_[fresh, len(values)]))
    _, column, count = np.unique(values | turn.astype(U64) << U64(32), return_inverse=True, return_counts=True)
    # What most members have tells none of them apart: the others must share the rest of what is asked for.
    common = count > len(texts) // 2
    need = least - common.sum()
    rare = (count > 1) & ~common
    usable = np.ones(len(texts), bool) if need <= 0 else np.bincount(who[rare[column]], minlength=len(texts)) >= need
    rest = np.flatnonzero(usable & (node != lead))
    mine = rest[open_[rest]]
    if len(rest) < 2 or not len(mine):
        return
    # Columns by their members only, so that memory goes by the block.
    row_at = np.full(len(texts), -1)
    row_at[rest] = np.arange(len(rest))
    at = (row_at[who] >= 0) & (count[column] > 1)
    who, column = row_at[who[at]], column[at]
    kept, column = np.unique(column, return_inverse=True)
    spots = (order - np.repeat(np.cumsum(sizes) - sizes, sizes))[at]
    repeats = np.zeros(len(texts), bool)
    repeats[np.repeat(np.arange(len(texts)), sizes)[turn > 0]] = True
    kind = np.dtype(np.int8 if sizes.max() < 128 else np.int32)
    where = None
    if len(rest) * (len(kept) + 1) * kind.itemsize <= 8 * CELLS:  # else all are aligned
        where, shingles = np.full((len(rest), len(kept) + 1), -1, kind), np.full((len(rest), sizes.max()), len(kept))
        where[who, column] = spots
        shingles[who, spots] = column
    for begin in range(0, len(mine), BLOCK):
        block = row_at[mine[begin : begin + BLOCK]]
        shared = np.zeros((len(block), len(rest)), np.float32)
        width = max(256, CELLS // len(rest))
        for low in range(0, len(kept), width):
            part = (column >= low) & (column < low + width)
            table = np.zeros((len(rest), min(width, len(kept) - low)), np.float32)
            table[who[part], column[part] - low] = 1
            shared += table[block] @ table.T
        i, j = np.nonzero(shared >= least)
        a, b = rest[block[i]], rest[j]
        ok = (node[a] != node[b]) & (~open_[b] | (a < b))
        a, b, score = a[ok], b[ok], shared[i, j][ok]
        order = np.argsort(-score, kind="stable")
        a, b = a[order], b[order]
        for low in range(0, len(a), BLOCK):
            i, j = a[low : low + BLOCK], b[low : low + BLOCK]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            x, y = np.where(node[i] > node[j], (i, j), (j, i))
            found: list = [None] * len(x)
            if where is not None:
                known = np.flatnonzero(~repeats[x] & ~repeats[y])
                p, q = x[known], y[known]
                for k, span in zip(known.tolist(), _around_all(where[row_at[q][:, None], shingles[row_at[p]]].astype(np.int32), first[p], last[p], first[q], last[q], t, similarity, gap)):
                    found[k] = span
            for p, q, span in zip(x.tolist(), y.tolist(), found):
                if label[p] != label[q]:
                    yield p, q, span() if callable(span) else span


def _around_all(at: np.ndarray, first: np.ndarray, last: np.ndarray, from_: np.ndarray, to: np.ndarray, t: int, similarity: float, gap: int) -> list:
    """For each row the longest passage (start, end, start, end, similarity) of ``align``'s kind that holds a key, or ();
    where only a part of a run can be one, a function that finds it.

    ``at`` has the place in y of each shingle of x (-1: none), of texts that repeat no shingle, so the shingles of a run
    lie in order in both and its set sizes are its lengths. The key stands at first to last in x and at from_ to to in y.
    """
    n, spot = len(at), np.arange(at.shape[1], dtype=np.int32)
    met, row = at >= 0, np.arange(n)
    before = np.full(at.shape, -1, np.int32)
    np.maximum.accumulate(np.where(met, spot, np.int32(-1))[:, :-1], 1, out=before[:, 1:])
    ahead, beyond = spot - before, at - np.take_along_axis(at, np.maximum(before, 0), 1)
    run = np.cumsum(met & ((before < 0) | (ahead > gap) | (beyond <= 0) | (abs(beyond - ahead) > gap)), 1, dtype=np.int32)
    met &= (run == run[row, first][:, None]) & met[row, first][:, None]
    starts, ends = met & (spot <= first[:, None]) & (at <= from_[:, None]), met & (spot >= last[:, None]) & (at >= to[:, None])
    low, high = starts.argmax(1), at.shape[1] - 1 - ends[:, ::-1].argmax(1)
    count = np.cumsum(met, 1, dtype=np.int32)

    def measure(row, low, high):
        both, wide, tall = count[row, high] - count[row, low] + 1, high - low + 1, at[row, high] - at[row, low] + 1
        return wide, (wide >= t) & (tall >= t), both / np.maximum(1, wide + tall - both)

    def part(k):
        a, b = np.flatnonzero(starts[k])[:, None], np.flatnonzero(ends[k])[None]
        wide, fits, scores = measure(k, a, b)
        rank = np.where(fits & (scores >= similarity), wide + scores / 2, 0)
        i, j = np.unravel_index(rank.argmax(), rank.shape)
        return (int(a[i, 0]), int(b[0, j]) + SHINGLE, int(at[k, a[i, 0]]), int(at[k, b[0, j]]) + SHINGLE, float(scores[i, j])) if rank[i, j] else ()

    _, fits, score = measure(row, low, high)
    able = starts[row, low] & ends[row, high] & fits
    spans = zip(low.tolist(), (high + SHINGLE).tolist(), at[row, low].tolist(), (at[row, high] + SHINGLE).tolist(), score.tolist())
    out = [span if ok else () for ok, span in zip((able & (score >= similarity)).tolist(), spans)]
    parts = np.flatnonzero(able & (score < similarity))
    # A part is alike enough if what its end is worth exceeds what its start is, of shingles shared less shingles spanned.
    worth = (1 + similarity) * count[parts] - similarity * (spot + at[parts])
    least = np.minimum.accumulate(np.where(starts[parts], worth, np.inf), 1)[:, : max(0, at.shape[1] - t + 1)]
    best = np.where(ends[parts], worth, -np.inf)[:, t - 1 :] - least
    for k in parts[(best > similarity - 1 - 1e-6).any(1)].tolist():
        out[k] = partial(part, k)
    return out


SPANS = "array<struct<start:long,end:long,lead_start:long,lead_end:long,similarity:double>>"


@small_batches
def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, keeper_id, keeper_start, keeper_end, similarity, is_keeper).

    One row for each passage of a document that another one shares; ends are exclusive. The keeper is the document
    whose passage stays; its own passages have rows with ``is_keeper``. Whole copies are passages of similarity 1.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    t = min_words - SHINGLE + 1

    def own(batches):
        for batch in batches:
            found = [(_nodes(piece.words, piece.bounds), np.diff(piece.bounds)) for piece in pieces(batch.column("text"), "space")]
            nodes, sizes = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes), pa.array(sizes)], names=["doc_id", "node", "n"]).filter(pa.array(sizes >= min_words))

    seen = cut(base.mapInArrow(lean(own), T.StructType([base.schema["doc_id"], *T._parse_datatype_string("node long, n long").fields])), "nodes")
    members = cut(seen.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n")), "nodes")

    def keyed(batch):
        for rows, nodes, _ in _keyed(batch.column("text"), t):
            yield np.ascontiguousarray(rows[:, 0]), nodes[rows[:, 1]]

    # About two windows a passage's length for each function, most with one key.
    lists = cut(shared_keys(base.select("text"), keyed, (seen.agg(F.sum("n")).first()[0] or 0) * 3 * HASHES // t), "lists")
    wanted = wanted_cells(lists, "key")

    def spread(batches):
        for batch in batches:
            for rows, nodes, _ in _keyed(batch.column("text"), t):
                rows = rows[wanted(rows[:, 0])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.ascontiguousarray(rows[:, 0]), nodes[rows[:, 1]], np.ascontiguousarray(rows[:, 2]), np.ascontiguousarray(rows[:, 3]))], names=["key", "node", "start", "end"])

    rows = base.select("text").mapInArrow(lean(spread), "key long, node long, start long, end long")
    # Dealt out anew, so that a key of very many rows is split where it is joined.
    open_ = cut(lookup(rows, lists, ["key"], "inner").repartition("key", "node", "start").distinct(), "open")
    release(lists)
    texts = _texts(base, open_.select("node").distinct(), members)

    leads = cut(open_.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("high"), F.count("*").alias("size")).filter("lead < high").drop("high"), "leads")
    paired = cut(open_.join(leads, "key").filter("node != lead"), "paired")
    release(open_)
    pairs = cut(paired.select("node", "lead").distinct(), "pairs")
    found = _aligned(pairs, texts, min_words, similarity, gap)
    # A key is settled for the nodes that align with its lead where the key's shingles are.
    settled = found.select("node", "lead", F.explode("spans").alias("s")).select("node", "lead", F.col("s.start").alias("from"), F.col("s.end").alias("to"))
    there = (F.col("p.node") == F.col("s.node")) & (F.col("p.lead") == F.col("s.lead")) & (F.col("from") <= F.col("start")) & (F.col("end") < F.col("to"))
    left = cut(paired.alias("p").filter("size > 2").join(settled.alias("s"), there, "left_anti").select("key", "node", "start"), "left")
    local = cut(_bridges(texts, left, leads, min_words, similarity, gap), "bridges")
    again = cut(local.select("node", "lead").distinct().join(pairs, ["node", "lead"], "left_anti"), "pairs")
    found = found.unionByName(_aligned(again, texts, min_words, similarity, gap))
    release(paired, leads, left, texts, pairs, again)

    spans = found.select("node", "lead", F.explode("spans").alias("s")).select("node", "lead", "s.*")
    # What was seen around a key only stands where the whole texts align otherwise.
    within = (F.col("b.node") == F.col("s.node")) & (F.col("b.lead") == F.col("s.lead")) & (F.col("s.start") <= F.col("b.first")) & (F.col("b.last") < F.col("s.end"))
    spans = cut(spans.unionByName(local.filter("start is not null").alias("b").join(spans.alias("s"), within, "left_anti").drop("first", "last").distinct()), "spans")
    reps = members.select(F.col("node").alias("lead"), F.col("rep").alias("keeper_id"))
    led = lookup(spans, reps, ["lead"], "inner")
    docs_of = seen.select("doc_id", "node")
    shared = docs_of.join(led, "node").select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "keeper_id", F.col("lead_start").alias("keeper_start"), F.col("lead_end").alias("keeper_end"), "similarity", F.lit(False).alias("is_keeper"))
    own = led.select("keeper_id", "lead_start", "lead_end").distinct().select(F.col("keeper_id").alias("doc_id"), F.col("lead_start").alias("start_word"), F.col("lead_end").alias("end_word"), "keeper_id", F.col("lead_start").alias("keeper_start"), F.col("lead_end").alias("keeper_end"), F.lit(1.0).alias("similarity"), F.lit(True).alias("is_keeper"))
    copies = lookup(docs_of, cut(members.filter("copies > 1").select("node", "rep", "n"), "copies"), ["node"], "inner")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("rep").alias("keeper_id"), F.lit(0).cast("long").alias("keeper_start"), F.col("n").alias("keeper_end"), F.lit(1.0).alias("similarity"), F.col("doc_id").eqNullSafe(F.col("rep")).alias("is_keeper"))
    return shared.unionByName(own).unionByName(whole)


def _texts(base: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, text) of the nodes, each from its smallest id; a few more nodes than asked for do no harm."""
    named = cut(nodes.join(members, "node").select("node", F.coalesce("rep", F.lit(0)).cast("long").alias("key")), "wanted")
    has_node, has_id = wanted_cells(named, "node"), wanted_cells(named, "key")

    def run(batches):
        for batch in batches:
            found = np.concatenate([_nodes(piece.words, piece.bounds) for piece in pieces(batch.column("text"), "space")] or [np.zeros(0, np.int64)])
            hit = pa.array(has_node(found) & has_id(batch.column("key").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("text")], names=["node", "text"]).filter(hit)

    texts = cut(base.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"), "text").mapInArrow(lean(run), "node long, text string"), "texts")
    release(named)
    if texts.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1").isEmpty():
        return texts
    return cut(texts.dropDuplicates(["node"]), "texts")  # ids that repeat


def _bridges(texts: DataFrame, left: DataFrame, leads: DataFrame, min_words: int, similarity: float, gap: int) -> DataFrame:
    """(node, lead, span, first, last): links that join what a key's list falls into once its lead has met all members.

    ``left``: (key, node, start) of the members that do not align with the lead there. The whole lists of their keys are
    dealt out, each member with the shingles around the key, so a list is handled in memory by ``bridges``.
    """
    t = min_words - SHINGLE + 1
    lists = cut(left.groupBy("key").agg(F.lit(1)).select("key").join(leads, "key").select("key", "size"), "lists")
    parts = max(LEAST_PARTS, (lists.agg(F.sum("size")).first()[0] or 0) // PART_ROWS)
    wanted = wanted_cells(lists, "key")

    def around(batches):
        for batch in batches:
            for piece in pieces(batch.column("text"), "space"):
                begin, end = piece.bounds[:-1], np.maximum(piece.bounds[:-1], piece.bounds[1:] - SHINGLE + 1)
                grams, nodes = ngrams(piece.words, SHINGLE), _nodes(piece.words, piece.bounds)
                rows = window_keys(grams, begin, end, t)
                rows = rows[wanted(rows[:, 0])]
                lo, hi = around_key(rows[:, 2], rows[:, 3], (end - begin)[rows[:, 1]], t)
                base = begin[rows[:, 1]]
                seen = (grams >> U64(32)).astype(np.uint32)
                near = [seen[i:j].tobytes() for i, j in zip((base + lo).tolist(), (base + hi).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (rows[:, 0], nodes[rows[:, 1]], rows[:, 2], rows[:, 3])] + [pa.array(near, pa.binary())], names=["key", "node", "start", "end", "near"])

    def join(batches):
        columns = [[], [], [], [], []]
        for batch in batches:
            for k in range(4):
                columns[k].append(batch.column(k).to_numpy(zero_copy_only=False))
            columns[4] += batch.column(4).to_pylist()
        if not columns[4]:
            return
        key, node, start, end = (np.concatenate(c) for c in columns[:4])
        mark = np.array([x is None for x in columns[4]])
        order = np.lexsort((mark, start, node, key))
        # A mark stands right behind the row that it is about.
        key, node, start, end, mark, near = key[order], node[order], start[order], end[order], mark[order], [columns[4][i] for i in order.tolist()]
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        out = []
        for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
            own = lo + np.flatnonzero(~mark[lo:hi])
            open_ = np.r_[mark[lo + 1 : hi], False][own - lo]
            if open_.any() and node[own[0]] != node[own[-1]]:
                out += bridges(node[own], start[own], end[own], [near[i] for i in own.tolist()], open_, min_words, similarity, gap)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    names = ["node", "lead", "start", "end", "lead_start", "lead_end", "similarity", "first", "last"]
    schema = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in names])
    members = texts.select("text").mapInArrow(lean(around), "key long, node long, start long, end long, near binary")
    marks = left.select("key", "node", "start", F.lit(0).cast("long").alias("end"), F.lit(None).cast("binary").alias("near"))
    return members.unionByName(marks).repartition(parts, "key").mapInArrow(lean(join), ", ".join(f"{f.name} {'double' if f.name == 'similarity' else 'long'}" for f in schema))


def _aligned(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float, gap: int) -> DataFrame:
    """(node, lead, spans) of the pairs that share a passage."""
    x, y = keep_wanted(texts.withColumnRenamed("text", "x"), pairs, "node"), keep_wanted(texts.toDF("lead", "y"), pairs, "lead")
    sides = pairs.join(x, "node").join(y, "lead")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lead_start", pa.int64()), ("lead_end", pa.int64()), ("similarity", pa.float64())]))
        names = [kind.value_type.field(i).name for i in range(5)]
        for batch in batches:
            spans = [align(x, y, min_words, similarity, gap) for (_, x), (_, y) in zip(_documents(batch.column("x")), _documents(batch.column("y")))]
            kept = pa.array([bool(s) for s in spans], pa.bool_())
            lists = pa.array([[dict(zip(names, s)) for s in row] for row in spans if row], kind)
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(kept), batch.column("lead").filter(kept), lists], names=["node", "lead", "spans"])

    return cut(sides.select("node", "lead", "x", "y").mapInArrow(lean(run), f"node long, lead long, spans {SPANS}"), "aligned")
