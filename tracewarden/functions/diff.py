"""Diff of two texts over words and punctuation: the longest common token sequence, as merged segments."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are tokens of their own.
SEPARATOR = re.compile("([，。！？、；：\"'（）《》【】\\s])")
BLOCK = 256  # rows of the table that are in memory at once, besides one row of every block


def tokens(text: str | None) -> list[str]:
    return [t for t in SEPARATOR.split(text or "") if t]


def _next_row(row: np.ndarray, token: int, columns: np.ndarray) -> np.ndarray:
    out = row.copy()
    np.maximum(out[1:], row[:-1] + (columns == token), out=out[1:])
    return np.maximum.accumulate(out)


def segments(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(kind, text) with kind equal, delete or insert, neighbours of one kind merged.

    Read from the end, equal tokens are matched first; of an insertion and a deletion that keep as long a common
    sequence the insertion goes last. Null counts as empty; equal texts give one segment, two empty ones none. Memory
    grows with the length of one text, not with the product: rows of the table are computed again block by block.
    """
    a, b = tokens(old), tokens(new)
    steps: list[tuple[str, str]] = []
    while a and b and a[-1] == b[-1]:
        steps.append(("equal", a.pop()))
        b.pop()
    codes = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
    columns = np.array([codes[t] for t in b], np.int64)
    kept, row = [], np.zeros(len(b) + 1, np.int32)
    for i, t in enumerate(a):
        if i % BLOCK == 0:
            kept.append(row)
        row = _next_row(row, codes[t], columns)
    i, j, block, rows = len(a), len(b), -1, []
    while i and j:
        if (i - 1) // BLOCK != block:
            block = (i - 1) // BLOCK
            rows = [kept[block]]
            for t in a[block * BLOCK : i]:
                rows.append(_next_row(rows[-1], codes[t], columns))
        at = i - block * BLOCK
        if a[i - 1] == b[j - 1]:
            steps.append(("equal", a[i - 1]))
            i, j = i - 1, j - 1
        elif rows[at][j - 1] >= rows[at - 1][j]:
            j -= 1
            steps.append(("insert", b[j]))
        else:
            i -= 1
            steps.append(("delete", a[i]))
    steps += [("insert", t) for t in reversed(b[:j])] + [("delete", t) for t in reversed(a[:i])]
    out: list[tuple[str, list[str]]] = []
    for kind, text in reversed(steps):
        if not out or out[-1][0] != kind:
            out.append((kind, []))
        out[-1][1].append(text)
    return [(kind, "".join(parts)) for kind, parts in out]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def text_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "text": t} for k, t in segments(a, b)] for a, b in zip(old, new)])
