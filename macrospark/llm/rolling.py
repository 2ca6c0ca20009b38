"""Rabin-Karp hashes of words and word windows over the raw bytes of a batch of texts, in numpy.

A word is hashed from running sums of byte x BASE^position modulo 2^64: the difference of two sums, divided by
BASE^start, does not depend on where the word stands. BASE is odd, so it has an inverse. The result is scrambled,
so that windows and buckets see even bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, WINDOW_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes hashed at once; a longer word is hashed alone.
PIECE = 1 << 18

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE + 1), base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data))[:len(data)], out=sums[1:])
    inverse = pow(BASE, -1, 1 << 64)
    return scramble((sums[ends] - sums[starts]) * _powers(inverse, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end (text k is data[offsets[k]:offsets[k + 1]]): the hash of each word, and the number
    of words before each text and at the end."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prior = np.empty(len(data), bool)
    if len(data):
        prior[0], prior[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & (prior | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # pieces end between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = starts[at], ends[to - 1]
        out[at:to] = _piece_hashes(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out, np.searchsorted(starts, offsets)


def window_hashes(found: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    if len(found) < width:
        return np.empty(0, np.uint64)
    n = len(found) - width + 1
    out = found[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(base) + found[k:k + n]
    return scramble(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    col = column.fill_null("") if column.null_count else column
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with up to `most` bytes of text each; a longer text comes alone."""
    data, offsets = text_buffers(batch.column(column))
    del data
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
