"""Words and word windows of Arrow text columns as numpy hash arrays.

A word is a run of characters other than space and U+0009 to U+000D. All functions work on the UTF-8 buffers of
a whole Arrow batch, so no Python string is made per word. Hashes have 64 bits and depend on the text alone,
never on the batch or the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    codes[[32, *range(9, 14)]] = 0
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {low: _byte_codes(low) for low in (False, True)}
_SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])


class Words(NamedTuple):
    """Words of a batch. Document ``i`` has the words ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of every text, as hashes and as byte ranges. ``lower`` folds A-Z."""
    data, offsets = buffers(texts)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SEPARATOR[data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(begin, offsets)
    if len(begin) == 0:
        return Words(np.zeros(0, np.uint64), first, begin, end, data)
    powers = np.cumprod(np.full(int((end - begin).max()) + 1, _BASE, np.uint64))
    low, high = int(begin[0]), int(end[-1])
    at = np.arange(low, high, dtype=np.int64)
    at -= np.repeat(begin, np.diff(np.append(begin, high)))
    # separators have code 0, so the place after a word does not matter
    terms = powers[np.minimum(at, len(powers) - 1, out=at)]
    terms *= _CODES[lower][data[low:high]]
    sums = np.add.reduceat(terms, begin - low)
    return Words(mix(sums), first, begin, end, data)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` neighbours; entry ``i`` covers ``i:i + size``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _STEP
        out += hashes[k : k + n]
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows and their bounds per document; a shorter text is one window."""
    counts = np.diff(w.first)
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    whole = counts >= size
    runs = windows(w.hashes, size)
    if whole.any():
        take = _ranges(w.first[:-1][whole], per_doc[whole])
        out[_ranges(bounds[:-1][whole], per_doc[whole])] = runs[take]
    for k in range(1, size):
        short = counts == k
        if short.any():
            at = w.first[:-1][short]
            value = np.full(len(at), k, np.uint64)
            for j in range(k):
                value = value * _STEP + w.hashes[at + j]
            out[bounds[:-1][short]] = mix(value)
    return out, bounds


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers ``start[i] .. start[i] + length[i] - 1``, one run after the other."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, with new bounds."""
    if len(values) == 0:
        return values, np.zeros(len(bounds), np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    parts = [np.sort(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
    values = np.concatenate(parts)
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[fresh], minlength=len(bounds) - 1)
    return values[fresh], np.concatenate([[0], np.cumsum(counts)])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text, to bound the work arrays."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        used = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, used + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
