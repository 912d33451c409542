"""Which keys do two different owners have? Found on packed arrays, without a row for each key in the JVM.

Tasks deal out (key, owner) pairs by the key's top bits, once for each key and at most two owners, so a hot key sends
two pairs for each batch that a task holds. The merging tasks sort them; their number grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .textnp import U64

FLUSH_ROWS, PART_ROWS, LEAST_PARTS = 1 << 20, 1 << 21, 32


def _extremes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (key, owner), and the places of each key's first and last owner."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0].view(U64)))]
    new = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    return rows, new, np.r_[new[1:], len(rows)] - 1


def shared_keys(frame: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], pairs: int) -> DataFrame:
    """(key) of the keys that two owners have; ``extract`` gives arrays of keys and owners (int64), ``pairs`` about how many there are."""
    parts = max(LEAST_PARTS, pairs // PART_ROWS)
    bits = (4 * parts - 1).bit_length()

    def deal(batches):
        held, n = [], 0

        def flush():
            rows, new, last = _extremes(np.concatenate(held))
            rows = rows[np.union1d(new, last[rows[last, 1] != rows[new, 1]])]
            part = (rows[:, 0].view(U64) >> U64(64 - bits)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            packed = [rows[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), cuts[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int64()), pa.array(packed, pa.binary())], names=["part", "packed"])

        for batch in batches:
            for keys, owners in extract(batch):
                if len(keys):
                    held.append(np.stack([keys, owners], 1))
                    n += len(keys)
                if n > FLUSH_ROWS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(batches):
        packed = [np.frombuffer(x, np.int64).reshape(-1, 2) for batch in batches for x in batch.column("packed").to_pylist()]
        if packed:
            rows, new, last = _extremes(np.concatenate(packed))
            yield pa.RecordBatch.from_arrays([pa.array(rows[new[rows[new, 1] != rows[last, 1]], 0])], names=["key"])

    return frame.mapInArrow(lean(deal), "part long, packed binary").repartition(parts, "part").mapInArrow(lean(merge), "key long")
