"""Words and word shingles of whole Arrow string columns as 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
All work is done on the UTF-8 bytes of a batch at once; a word's hash is a sum of
per-byte keys times powers of an odd base, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(256, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, and one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_starts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> np.ndarray:
    """Places of the first bytes of all words; a row's first byte begins a word if it is within one."""
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    return np.flatnonzero(begin)


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the index of its first word (with the end); bytes in ``space`` part words."""
    global _POWERS
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begin[at])
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    if sizes.max() > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(int(sizes.max()) * 2, _BASE, np.uint64))
    terms = _KEYS[fold][data[at]] * _POWERS[place]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64)), bounds


def words_at(data: np.ndarray, starts: np.ndarray, some: np.ndarray, space: np.ndarray = _SPACE) -> pa.Array:
    """Lower-cased texts of the words ``some`` (indexes into ``starts``, the first bytes of all words)."""
    if not len(some):
        return pa.array([], pa.string())
    sizes = np.add.reduceat(~space[data], starts, dtype=np.int64)[some]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes), sizes)
    out = _LOWER.astype(np.uint8)[data[at]]
    return pa.StringArray.from_buffers(len(some), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out))


def line_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bounds of rows in lines, hashes of lines by their words, and words of lines, for one part of ``column`` after the other."""
    powers = _POWERS
    data, offsets = byte_rows(column)
    for first, last in row_chunks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        text, rows = data[offsets[first] : offsets[last]], np.arange(last - first)
        words, bounds = hash_words(text, own)
        before = np.concatenate([[0], np.cumsum(text == 10)])
        line = np.repeat(rows, np.diff(bounds)) + before[word_starts(text, own)]
        ends = np.append(rows, last - first) + before[own]
        counts = np.bincount(line, minlength=int(ends[-1]))
        head = np.cumsum(counts) - counts
        if counts.max(initial=0) > len(powers):
            powers = np.multiply.accumulate(np.full(int(counts.max()) * 2, _BASE, np.uint64))
        terms = words * powers[np.arange(len(words)) - head[line]]
        out = counts.astype(np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] += np.add.reduceat(terms, head[some])
        yield ends, mix(out), counts


def windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a row; fewer words count as one window."""
    counts = np.diff(bounds)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    ends = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(int(ends[-1]), np.uint64)
    row = np.repeat(np.arange(len(counts)), per_row)
    start = bounds[row] + np.arange(len(out)) - ends[row]
    size = np.minimum(counts[row], width)
    for k in range(width):
        has = k < size
        out[has] += words[start[has] + k] * factors[k]
    return mix(out + size.astype(np.uint64)), ends


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes, for each row of ``column``."""
    data, offsets = byte_rows(column)
    for first, last in row_chunks(offsets):
        own = offsets[first : last + 1]
        words, bounds = hash_words(data[own[0] : own[-1]], own - own[0])
        grams, ends = windows(words, bounds, width)
        for k in range(last - first):
            yield first + k, np.unique(grams[ends[k] : ends[k + 1]])


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    data, offsets = byte_rows(column)
    out = np.zeros(len(column), np.int64)
    for first, last in row_chunks(offsets):
        own = offsets[first : last + 1]
        inside = ~_SPACE[data[own[0] : own[-1]]]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = own[:-1][own[:-1] < own[1:]] - own[0]
        begin[heads] = inside[heads]
        total = np.concatenate([[0], np.cumsum(begin)])
        out[first:last] = np.diff(total[own - own[0]])
    return out
