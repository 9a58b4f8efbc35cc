"""Numpy over Arrow text columns inside tasks: word hashes and byte n-grams without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
PIECE = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


def fmix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) over runs of rows of about CHUNK bytes; null is empty; no row is cut."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("").cast(pa.large_string())
    if not len(text):
        return
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, "right")) - 1)
        yield i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a chunk."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(ends, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes by differences of a running sum, then mixed. Runs of words of
    about PIECE bytes are summed at a time (a longer word alone), so that 64-bit numbers never lie beside all bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = min(len(raw), max(PIECE, int((end - start).max())))
    power = np.full(n + 1, 0xD6E8FEB86659FD93, np.uint64)
    inverse = np.full(n + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + n, "right"))
        a, z = start[i:j] - start[i], end[i:j] - start[i]
        total = np.zeros(int(z[-1]) + 1, np.uint64)
        np.cumsum((raw[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)) * power[: len(total) - 1], out=total[1:])
        out[i:j] = (total[z] - total[a]) * inverse[a]
        i = j
    return fmix(out)
