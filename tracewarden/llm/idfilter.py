"""A bitmap semi-join filter: rows whose key can be among the wanted ones, before any shuffle.

The bitmap has 64 bits for each wanted key, between 2**20 and 2**28 bits (32 MB), so what is broadcast is bounded; a
set too large for it lets more rows through, never fewer. A join afterwards drops the false hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .textnp import U64, mix

CHUNKS = 64
LEAST_BITS, MOST_BITS = 20, 28


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64)


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def keep_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` (long; null counts as 0) may occur in ``wanted``."""
    return split_wanted(rows, wanted, key)[0]


def split_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` (long; null counts as 0) may occur in ``wanted``, and those whose key surely doesn't."""
    test = wanted_cells(wanted, key)

    def side(hit):
        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array(test(_keys(batch.column(key))) == hit))

        return rows.mapInArrow(lean(keep), rows.schema)

    return side(True), side(False)


def wanted_cells(wanted: DataFrame, key: str):
    """A test for use in tasks: of an array of keys, those that may occur in ``wanted`` (by a broadcast bitmap)."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(64 * wanted.count()).bit_length()))
    per = (1 << bits) // CHUNKS

    def mark(batches):
        cells = np.unique(np.concatenate([np.zeros(0, np.int64), *(_cells(_keys(batch.column("k")), bits) for batch in batches)]))
        ends = np.searchsorted(cells, np.arange(CHUNKS + 1) * per)
        for chunk, (lo, hi) in enumerate(zip(ends.tolist(), ends.tolist()[1:])):
            if lo < hi:
                part = np.zeros(per, bool)
                part[cells[lo:hi] - chunk * per] = True
                yield _row(chunk, np.packbits(part))

    def unite(batches):
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist()):
                part = np.frombuffer(packed, np.uint8)
                marks[chunk] = marks[chunk] | part if chunk in marks else part
        for chunk, part in marks.items():
            yield _row(chunk, part)

    schema = "chunk int, packed binary"
    found = wanted.select(wanted[key].cast("long").alias("k")).mapInArrow(lean(mark), schema).repartition(CHUNKS // 4, "chunk").mapInArrow(lean(unite), schema).collect()
    bitmap = np.zeros((CHUNKS, per // 8), np.uint8)
    for chunk, packed in found:  # at most CHUNKS rows, at most 32 MB together
        bitmap[chunk] = np.frombuffer(bytes(packed), np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def test(keys: np.ndarray) -> np.ndarray:
        cells = _cells(keys, bits)
        return (held.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)

    return test


def _row(chunk: int, packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["chunk", "packed"])
