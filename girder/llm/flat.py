"""Flat numpy views of Arrow text columns.

A batch of texts is handled as one byte array with document offsets, so that
word splitting and hashing are a few array passes and not a Python loop per word.
Work goes in slices of a few megabytes, which bounds a task's memory whatever
the batch holds (one text is never split, so a slice is at least one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
BASE = U64(0x9E3779B97F4A7C55)
SEQ_BASE = U64(0xD6E8FEB86659FD93)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(29))
        x = x * U64(0xA0761D6478BD642F)
        return x ^ (x >> U64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd, so it has an inverse."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = U64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.full(size, base, U64)
            up[0] = 1
            down = np.full(size, inverse, U64)
            down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * SLICE_BYTES:
            _tables[int(base)] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal sequences have equal hashes wherever they stand."""
    up, down = powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x8CB92BA72F3D8DD7))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each slice; null texts are empty."""
    texts = batch.column(column).cast(pa.large_utf8()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that cross no document's edge, and each document's offset in them."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n:
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Bytes that are no white space: all but U+0020 and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of alphanumeric words: digits, a to z in either case, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(member[data], offsets)


def window_hashes(values: np.ndarray, k: int, base: np.uint64 = SEQ_BASE) -> np.ndarray:
    """The hash of each k consecutive values (none if there are fewer)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return span_hashes(values, at, at + k, base)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i]+1, ... of each i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the intervals [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
