"""Tokens and n-grams of whole Arrow batches, hashed with numpy on the UTF-8 bytes; no loop over characters or words.

A batch is cut into slices of about ``SLICE_BYTES`` of text, so memory is bounded by that or by one text. Bytes of
letters, digits, ``_`` and of every character beyond ASCII make words; all other bytes but white space make marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

SPACE, WORD, MARK = 0, 1, 2
CLASS = np.full(256, MARK, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[128:] = WORD
CLASS[[ord(c) for c in "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = WORD

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of whole rows with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text begins (one more for the end). Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, factor, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def tokens(data: np.ndarray, at: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and tokens per text. Tokens are words, and with ``marks`` also runs of marks."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(at) - 1, np.int64)
    kind = CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    wanted = kind[begin] != SPACE if marks else kind[begin] == WORD
    begin, end = begin[wanted], end[wanted]
    counts = np.diff(np.searchsorted(begin, at))
    return hashed_runs(data, begin, end), counts


def hashed_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run from ``begin`` to before ``end``."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:len(data)], out=total[1:])
    return mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64))


def grams(hashed: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` tokens, and runs per text. A text of fewer tokens, but one at least, has a single run of all of them."""
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    total = int(runs.sum())
    if not total:
        return np.zeros(0, U64), runs
    text = np.repeat(np.arange(len(counts)), runs)
    begin = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + first[text]
    size = np.minimum(counts, n)[text]
    padded = np.append(hashed, np.zeros(n, U64))
    out = size.astype(U64)
    for k in range(n):
        step = mix64(out * U64(0x9E3779B97F4A7C15) + padded[begin + k])
        out = step if k == 0 else np.where(size > k, step, out)
    return out, runs


def distinct_per_text(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and without repeats within each text, and how many each text has left."""
    values = values.copy()
    ends = np.cumsum(runs)
    for stop, size in zip(ends, runs):
        values[stop - size:stop].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = (ends - runs)[runs > 0]
    keep[starts] = True
    left = np.zeros(len(runs), np.int64)
    if len(values):
        left[runs > 0] = np.add.reduceat(keep.astype(np.int64), starts)
    return values[keep], left
