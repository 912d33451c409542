"""Exact Jaccard self-join of documents on word shingles: the grouped prefix join.

Shingles are ordered by how often they occur in the corpus (rare first); two sets of similarity t or more share a
shingle among their first n - ceil(t * n) + 1. The order comes from a counting sketch of fixed size (any one order is
exact; a good one keeps posting lists short, so the sketch only has to tell the frequent from the rare).

1. Documents with equal shingle sets are one class; classes with the same prefix and set size are one group.
2. Group pairs: the groups of a prefix shingle's posting list are paired with the list's lead, filtered by size and
   by prefix positions of the shared shingle, and their representatives verified on whole texts; members of a group likewise with its
   first. Components of these links settle most lists at once, however long: no list is paired with itself.
3. Expansion: in lists and groups that still hold several components, members of different components are paired, filtered and
   verified. Every pair that shares a prefix shingle is thus either verified or already in one component, so the
   components are exactly those of all links.

A pair is verified on whole texts only if the parity bitmaps of its sets allow the similarity: each set has a bitmap of
about two bits a shingle, which flips the bit of each shingle's hash; bits that differ are never more than shingles
that do, so the bound loses no link.

Edge cases: null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a shingle
are one shingle; repeated rows are copies; a null id never becomes a component id while another id is in reach; an
empty table gives no rows. Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_HASHES, cut, lean, lookup, pick, row_hashes, small_batches, tagged, untagged
from .components import components
from .idfilter import split_wanted, wanted_cells
from .sharing import shared_keys
from .textnp import U64, shingle_sets

SKETCH_BITS, CHUNKS = 20, 256
PARITY_BITS = (64, 1 << 16)  # least and most bits of a set's bitmap; powers of two


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Shingle occurrences by the top bits of their hashes, summed over all documents: 2**SKETCH_BITS counts, always."""

    def count(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held, n = [], 0
            for s in shingle_sets(batch.column("text"), k):
                held.append(s)
                n += len(s)
                if n > 1 << 20:
                    cells += np.bincount((np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
                    held, n = [], 0
            if n:
                cells += np.bincount((np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
        if cells.any():
            yield from rows(enumerate(cells.reshape(CHUNKS, -1)))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(counts, np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield from rows(sums.items())

    def rows(parts):
        for chunk, counts in parts:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(lean(count), schema).repartition(CHUNKS // 4, "chunk").mapInArrow(lean(add), schema)
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.int64)
    for chunk, counts in parts.collect():  # CHUNKS rows at any size of the corpus
        out[chunk] = np.frombuffer(bytes(counts), np.int64)
    return out.reshape(-1)


def node_of(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def parity(shingles: np.ndarray) -> bytes:
    """Bitmap of the set: the bit of each shingle's low hash bits, flipped once for each shingle."""
    least, most = PARITY_BITS
    bits = min(most, max(least, 1 << (2 * len(shingles) - 1).bit_length() if len(shingles) else 0))
    counts = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ; the longer bitmap is folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, node, grp, prefix, bits): set size, 128-bit hash of the set, group key, prefix shingles in order, parity bitmap.

    Columns of ``docs`` besides doc_id and text come along.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, k))
    own = [name for name in docs.columns if name != "text"]
    schema = T.StructType([*[docs.schema[name] for name in own], *T._parse_datatype_string("n long, node binary, grp long, prefix array<long>, bits binary").fields])

    def run(batches):
        counts = sketch.value
        for batch in batches:
            sizes, nodes, groups, ends, flat, bits = [], [], [], [0], [], []
            for s in shingle_sets(batch.column("text"), k):
                n = len(s)
                sizes.append(n)
                nodes.append(node_of(s))
                prefix = s[:0]
                if n:
                    keep = n - -(-num * n // den) + 1
                    prefix = s[np.lexsort((s, counts[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]]
                    groups.append(int.from_bytes(blake2b(prefix.tobytes() + n.to_bytes(8), digest_size=8).digest(), "big", signed=True))
                else:
                    groups.append(None)
                bits.append(parity(s) if n else None)
                flat.append(prefix)
                ends.append(ends[-1] + len(prefix))
            tokens = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in own], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(groups, pa.int64()), lists, pa.array(bits, pa.binary())], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, token) of the prefixes of a batch, flattened."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("prefix")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, pc.list_flatten(batch.column("prefix")).to_numpy(zero_copy_only=False).astype(np.int64)


def _postings(batch: pa.RecordBatch):
    row, _, token = _flat(batch)
    yield token, batch.column("grp").to_numpy(zero_copy_only=False)[row]


def _shared_postings(in_lists, in_crowd=None):
    """Rows (grp, n, i, token) of tokens that may be shared; groups that surely are of one document only where a test for
    the others is given."""

    def run(batches):
        for batch in batches:
            if in_crowd is not None:
                batch = batch.filter(pa.array(~in_crowd(batch.column("grp").to_numpy())))
            row, place, token = _flat(batch)
            keep = in_lists(token)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(at), batch.column("n").take(at), pa.array(place[keep].astype(np.int32)), pa.array(token[keep])], names=["grp", "n", "i", "token"])

    return run


def _fits(num: int, den: int, na: str, nb: str, ia: str, ib: str) -> F.Column:
    """Sizes, and prefix positions of the first shared shingle, that allow the similarity.

    A pair's first shared shingle leaves at most least(na - ia, nb - ib) shared ones, of which the similarity needs
    num / (num + den) of na + nb; later shared shingles need not pass.
    """
    small, large = F.least(na, nb), F.greatest(na, nb)
    most = F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib))
    return (den * small >= num * large) & ((num + den) * most >= num * (F.col(na) + F.col(nb)))


def possible(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, rep_a, rep_b) of the pairs of nodes whose parity bitmaps allow the similarity."""
    sides = pairs
    for x in ("a", "b"):
        sides = sides.join(members.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    out = sides.select("a", "b", "rep_a", "rep_b")
    names, schema = out.columns, out.schema

    def may(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                most = (n + m - differing(x, y)) // 2
                ok.append(den * most >= num * (n + m - most))
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    return cut(sides.mapInArrow(lean(may), schema), "possible")


def verified(tried: DataFrame, docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets have the similarity."""
    pairs = possible(tried, members, num, den)
    reps = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep")))
    wanted = cut(reps.select(F.coalesce("rep", F.lit(0)).cast("long").alias("key")).distinct(), "wanted")
    test = wanted_cells(wanted, "key")

    def own(batches):
        for batch in batches:
            batch = batch.filter(pa.array(test(batch.column("key").to_numpy())))
            nodes = [node_of(s) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], names=["node", "text"]).filter(pa.array([x is not None for x in nodes], pa.bool_()))

    # Ids may repeat, and with them texts; texts that no pair names fall out of the joins.
    near = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"), "text")
    texts = cut(near.mapInArrow(lean(own), "node binary, text string"), "texts")
    if not texts.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1").isEmpty():
        texts = cut(texts.dropDuplicates(["node"]), "texts")
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return cut(sides.select("a", "b", "ta", "tb").mapInArrow(lean(check), "a binary, b binary"), "links")


@small_batches
def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links when den * |A & B| >= num * |A | B|. Returns documents (doc_id, n, node) and classes (node, rep, root, component_id).

    The second has a row for every distinct shingle set: rep is its smallest id, root the node that names its component.
    """
    return _components(pick(docs, doc_id=id_col, text=text_col), k, num, den)


def _components(base: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """As ``similar_components``; further columns of ``base`` come along in the first table."""
    sig = cut(signatures(base, k, num, den), "signatures")
    full = sig.filter("n > 0")
    members = cut(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("grp").alias("grp"), F.min("n").alias("n"), F.first("bits").alias("bits")), "members")
    # Only groups of several documents are brought together; prefixes of all others stay where they are.
    crowded = cut(full.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1").select("grp"), "crowded")
    lists = cut(shared_keys(full.select("grp", "prefix"), _postings, full.agg(F.sum(F.size("prefix"))).first()[0] or 0).select(F.col("key").alias("token")), "lists")
    in_crowd, in_lists = wanted_cells(crowded, "grp"), wanted_cells(lists, "token")
    schema = "grp long, n long, i int, token long"
    single = full.select("grp", "n", "prefix").mapInArrow(lean(_shared_postings(in_lists, in_crowd)), schema)
    several, _ = split_wanted(full.select("grp", "n", "prefix"), crowded, "grp")
    several = cut(several.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    several = several.mapInArrow(lean(_shared_postings(in_lists)), schema)
    shared = cut(lookup(single.unionByName(several), lists, ["token"], "inner"), "shared")
    # The lead has the shingle earliest: it has the fewest rarer ones of its own, so it is the likeliest original.
    leads = shared.groupBy("token").agg(F.min(F.struct("i", "grp", "n")).alias("lead"))

    # Group pairs: each group with the lead of its lists; members of a group with its first.
    heads = members.groupBy("grp").agg(F.min("node").alias("node"), F.count("*").alias("size"))
    star = shared.join(leads, "token").filter("grp != lead.grp").select("grp", F.col("lead.grp").alias("to"), "n", F.col("lead.n").alias("m"), "i", F.col("lead.i").alias("j"))
    star = star.filter(_fits(num, den, "n", "m", "i", "j")).select("grp", "to").distinct()
    star = star.join(heads.select("grp", F.col("node").alias("a")), "grp").join(heads.select(F.col("grp").alias("to"), F.col("node").alias("b")), "to").select("a", "b")
    inner = members.join(heads.filter("size > 1").select("grp", F.col("node").alias("a")), "grp").filter("node != a").select("a", F.col("node").alias("b"))
    tried = cut(star.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(tried, base, members, k, num, den)

    # Expansion: members of different components in one list, each list's largest component on one side only.
    roots = components(links)
    homes = cut(members.select("node", "grp", "n").join(roots, "node", "left").select("node", "grp", "n", F.coalesce("root", "node").alias("root")), "homes")
    # A group of several nodes is a list of its own: other groups need not have any of its shingles.
    own = heads.filter("size > 1").select(F.col("grp").alias("token"), "grp", F.lit(0).alias("i"))
    spots = cut(shared.select("token", "grp", "i").unionByName(own).join(homes, "grp").select("token", "node", "n", "i", "root", F.xxhash64("root").alias("r")), "spots")
    mixed = spots.groupBy("token", "r").agg(F.count("*").alias("size")).groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("size", "r"))["r"].alias("major")).filter("roots > 1")
    spots = cut(lookup(spots, cut(mixed.select("token", "major"), "mixed"), ["token"], "inner"), "spots")
    left = spots.filter("r != major").select("token", "major", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("r").alias("ra"))
    right = spots.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("r").alias("rb"))
    cross = left.join(right, "token").filter((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("major")) | (F.col("ra") < F.col("rb"))) & _fits(num, den, "na", "nb", "ia", "ib"))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    cross = cut(cross, "pairs")
    if not cross.isEmpty():
        more = verified(cross, base, members, k, num, den)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
            links = links.unionByName(more)
    roots = cut(roots, "roots")

    linked = members.join(roots, "node")
    names = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links_verified"))
    classes = members.join(roots, "node", "left").join(names, "root", "left").join(degree, "node", "left")
    classes = classes.select("node", "rep", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links_verified", F.lit(0)).alias("links_verified"))
    return sig.drop("grp", "prefix", "bits"), cut(classes, "classes")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **columns) -> DataFrame:
    """(doc_id, n_shingles, component_id, links_verified) of every document.

    links_verified counts the links of the document's class that were verified; links implied by a shared component
    are not all tried.
    """
    sig, classes = similar_components(docs, k, num, den, **columns)
    # A class of one document that links with nothing is its own component: no join needed for it.
    big = sig.filter("n > 0").groupBy("node").agg(F.count("*").alias("copies")).filter("copies > 1").select("node")
    known = classes.filter("root != node or links_verified > 0").select("node").unionByName(big).distinct()
    named = cut(classes.join(known, "node").select("node", "component_id", "links_verified", F.lit(True).alias("known")), "named")
    out = lookup(sig, named, ["node"], "left")
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("links_verified", F.lit(0)).alias("links_verified"))


@small_batches
def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component (the smallest id's); texts without words stay.

    Null ids come last, equal ids go by a hash of the row; of rows equal in all columns one stays. Only ids and hashes
    are ranked. The rows to drop are taken out by a broadcast of their hashes if those are few, else the rows that a
    bitmap can't clear are joined with them.
    """
    rows, names = tagged(docs)
    safe = dict(reversed([(name, x) for x, name in names]))
    if missing := {id_col, text_col} - {*safe}:
        raise ValueError(f"missing columns {sorted(missing)}; the table has {docs.columns}")
    hashes = row_hashes([x for x, _ in names])
    sig, classes = _components(rows.select(F.col(safe[id_col]).alias("doc_id"), F.col(safe[text_col]).alias("text"), *hashes), k, num, den)
    worded = sig.filter("node is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "row2")
    firsts = cut(worded.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("copies")), "firsts")
    linked = classes.filter("root != node or links_verified > 0")
    heads = linked.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("head"))
    gone = linked.join(heads, "root").filter("node != head.node").select("node", F.lit(True).alias("gone"))
    fates = firsts.join(gone, "node", "left").filter("gone or copies > 1").select("node", "gone", "first")
    dropped = lookup(worded.select("node", "row", "row2"), cut(fates, "fates"), ["node"], "inner").filter("gone or row != first.row or row2 != first.row2")
    dropped = cut(dropped.select("row", "row2").distinct(), "dropped")
    rows = rows.select("*", *hashes)
    if dropped.count() <= BROADCAST_HASHES:
        kept = rows.join(F.broadcast(dropped), ["row", "row2"], "left_anti")
    else:
        maybe, surely = split_wanted(rows, dropped, "row")
        kept = surely.unionByName(maybe.join(dropped, ["row", "row2"], "left_anti"))
    # Rows equal in all columns share their fate; the few that are kept more than once meet at last.
    twins = worded.groupBy("row", "row2").agg(F.count("*").alias("size")).filter("size > 1").select("row", "row2")
    twins = cut(twins.join(dropped, ["row", "row2"], "left_anti"), "twins")
    if not twins.isEmpty():
        again = lookup(kept, twins.withColumn("twin", F.lit(True)), ["row", "row2"], "left")
        kept = again.filter("twin is null").unionByName(again.filter("twin").dropDuplicates(["row", "row2"]))
    return untagged(kept, names)
