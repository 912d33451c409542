"""Vectorised word and shingle hashing over Arrow string batches (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 18  # documents are hashed in pieces of about this size; one longer document is one piece

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Word classes: runs of bytes other than ASCII white space; runs of ASCII letters, digits and all non-ASCII.
CLASSES = {"space": _NOT_SPACE, "alnum": _ALNUM}

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(PIECE_BYTES * 2, n)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@dataclass
class Piece:
    """Words of some documents: hash, first byte and end byte (in ``data``); ``bounds[i]:bounds[i+1]`` are those of document ``first + i``."""

    first: int
    words: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    total: np.ndarray  # running sums that hash any byte span

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans (none empty)."""
        low = np.where(start > 0, self.total[start - 1], U64(0)) if len(start) else np.zeros(0, U64)
        return mix((self.total[end - 1] - low) * _powers[1][start] ^ (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def documents(self) -> np.ndarray:
        """The document of each word, counted within the piece."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, kind: str = "space", lower: bool = True) -> Iterator[Piece]:
    data, offsets = buffers(column)
    table, i, n = CLASSES[kind], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
        j = min(j, n)
        yield _piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, table, lower)
        i = j


def _piece(data: np.ndarray, offsets: np.ndarray, first: int, table: np.ndarray, lower: bool) -> Piece:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Piece(first, none.astype(U64), none, none, np.zeros(len(offsets), np.int64), data, offsets, none.astype(U64))
    inside = table[data]
    edge = np.zeros(n + 1, bool)  # between bytes i-1 and i a document ends
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    powers, _ = _power_tables(n)
    total = np.cumsum((_LOWER[data] if lower else data).astype(U64) * powers[:n] + powers[:n], dtype=U64)
    piece = Piece(first, total, start, end, np.searchsorted(start, offsets), data, offsets, total)
    piece.words = piece.spans(start, end)
    return piece


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (across documents too: callers cut by bounds)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U64(0x9DDFEA08EB382D69)
        out ^= out >> U64(29)
        out += words[j : j + n]
    return mix(out + U64(k))


def shingle_sets(column: pa.Array, k: int, kind: str = "space") -> Iterator[np.ndarray]:
    """For each text the sorted distinct k-word shingle hashes; with fewer words, the whole sequence as one; without words, empty."""
    for piece in pieces(column, kind):
        grams = ngrams(piece.words, k)
        bounds = piece.bounds.tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= k:
                part = np.sort(grams[lo : hi - k + 1])
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                yield part[keep]
            elif hi > lo:
                yield ngrams(piece.words[lo:hi], hi - lo)
            else:
                yield np.zeros(0, U64)
