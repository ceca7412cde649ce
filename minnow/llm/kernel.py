"""Vectorised text kernels: whole Arrow batches at once, bytes in, numpy arrays out.

A text column is one byte buffer with row offsets. Separators of all word rules used
here are ASCII, so UTF-8 bytes can be split without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C55)
INVERSE = U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
#: Bytes that one block holds at most, unless a single text is longer.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = [np.ones(0, U64), np.ones(0, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, kept for later calls."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(end, n), data[off[at] : off[min(end, n)]], off[at : min(end, n) + 1] - off[at]
        at = min(end, n)


@cache
def word_table() -> np.ndarray:
    """A-Z lower-cased; ASCII letters, digits and all bytes of other characters kept; the rest 0."""
    t = np.zeros(256, np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    t[keep] = keep
    t[0x41:0x5B] = range(0x61, 0x7B)
    return t


@cache
def token_table(lower: bool) -> np.ndarray:
    """All but space and \\x09-\\x0D kept (NUL becomes 0xFF, which UTF-8 lacks)."""
    t = np.arange(256).astype(np.uint8)
    t[0] = 0xFF
    t[[0x20, *range(0x09, 0x0E)]] = 0
    if lower:
        t[0x41:0x5B] = range(0x61, 0x7B)
    return t


def spans(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of kept bytes within rows, and row bounds over the runs."""
    n = len(kept)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = kept[:-1], kept[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: prefix sums of a polynomial, shifted to the run's start and mixed."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(norm))
    total = np.zeros(len(norm) + 1, U64)
    np.cumsum(norm.astype(U64) * up[: len(norm)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and row bounds over them."""
    norm = table[data]
    starts, ends, bounds = spans(norm != 0, offsets)
    return run_hashes(norm, starts, ends), starts, ends, bounds


@cache
def window_keys(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1).astype(U64) * BASE) | U64(1)


def windows(h: np.ndarray, bounds: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-word windows; with short, a row of fewer words is one window."""
    n, keys = len(h), window_keys(k)
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    first = np.repeat(bounds[:-1], np.maximum(counts - k + 1, 0)) + ranges(np.maximum(counts - k + 1, 0))
    out = np.zeros(len(first), U64)
    for j in range(k):
        out += h[first + j] * keys[j]
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        more = np.zeros(len(few), U64)
        for j in range(k - 1):
            more += np.where(j < counts[few], h[np.minimum(bounds[few] + j, n - 1)], U64(0)) * keys[j]
        out, rows = np.concatenate([out, more]), np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return mix(out), rows


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - starts


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over values[bounds[i]:bounds[i + 1]], 0 for empty ones."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if full.size:
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key): whether it occurs twice or more in its row; whether an equal one stands before it."""
    n = len(keys)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        tagged = mix(keys ^ (rows.astype(U64) * BASE))
        order = np.argsort(tagged, kind="stable")
        same = (tagged[order][1:] == tagged[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later


def crc_text(ids: pa.Array) -> np.ndarray:
    """crc32 of each id as text; of the empty text for null."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))
