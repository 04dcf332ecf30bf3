"""Filters of a fixed number of bits that tell which rows of words may be in a table; what is in it is always told."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import mix

#: log2 of the bits of a filter: 8 MB.
_BITS = 26


def cells(salt: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Bit of a filter, for each row of words."""
    out = salt.astype(np.uint64)
    for w in words:
        out = mix(out ^ w.view(np.uint64))
    return (out >> np.uint64(64 - _BITS)).astype(np.int64)


def salts(kinds: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in kinds], np.uint64)


def empty_filter() -> np.ndarray:
    return np.zeros(1 << (_BITS - 6), np.uint64)


def bit_filter(rows: DataFrame, kind: str, words: list[str]) -> np.ndarray:
    """A filter of the rows' (kind, words): 64-bit words of 2**26 bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            salt = salts(own.dictionary.to_pylist())[own.indices.to_numpy()] if len(batch) else np.zeros(0, np.uint64)
            cell = np.unique(cells(salt, [c.to_numpy() for c in batch.columns[1:]]))
            yield pa.record_batch({"at": cell >> 6, "bit": cell & 63})

    marks = rows.select(kind, *words).mapInArrow(mark, "at long, bit long")
    found = marks.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS int))")).alias("bits")).toPandas()  # one row for each 64 bits at most
    out = empty_filter()
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def has(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) != 0
