"""Sets of word shingles: their hashes, names, and the band keys by which similar sets meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from girder.llm.flat import BYTE_VALUES, LOWER, NOT_SPACE, SEQ_BASE, U64, mix, ragged, span_hashes, text_slices, words

#: A band is ROWS minima of the set; two sets of Jaccard similarity s share one of the bands with a chance of
#: 1 - (1 - s**ROWS)**BANDS, which is 0.99993 at 0.8.
BANDS, ROWS = 24, 5
#: Bytes of texts that are hashed at once.
SLICE = 1 << 20


def shingles(batch: pa.RecordBatch, text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of a batch the hashes of all shingles (A-Z in lower case; a shorter text is one), and each text's
    bounds in them."""
    for _, _, data, offsets in text_slices(batch, text, SLICE):
        data = LOWER[data]
        starts, ends, bound = words(data, offsets, NOT_SPACE)
        hashes = span_hashes(BYTE_VALUES[data], starts, ends)
        n = np.diff(bound)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = ragged(bound[:-1], count)
        yield span_hashes(hashes, at, at + np.repeat(np.minimum(n, size), count), SEQ_BASE), np.concatenate([[0], np.cumsum(count)])


def node_of(grams: np.ndarray) -> int:
    """A name of a set of shingles, from its sorted hashes."""
    return int(span_hashes(grams, np.array([0]), np.array([len(grams)]), SEQ_BASE).view(np.int64)[0]) if len(grams) else 0


def band_keys(grams: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has shingles."""
    at = bound[:-1][np.diff(bound) > 0]
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64)) | U64(1)
    keys = np.zeros((len(at), BANDS), U64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            low = np.minimum.reduceat(grams * seeds[2 * i] + seeds[2 * i + 1], at)
            keys[:, i // ROWS] = mix((keys[:, i // ROWS] if i % ROWS else U64(i)) ^ low)
    return keys


def majority(grams: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The SimHash of each text: bits set in over half of its shingles' hashes, zero without any."""
    out = np.zeros(len(bound) - 1, U64)
    for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
        ones = np.zeros(64, np.int64)
        for lo in range(a, b, 1 << 14):
            ones += np.unpackbits(grams[lo : min(b, lo + (1 << 14))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > b - a, bitorder="little").view(U64)[0]
    return out
