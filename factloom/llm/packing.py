"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are words. A document longer than the largest capacity is cut into pieces. The
pieces are dealt over blocks by a hash, and each block is packed on its own: longest first,
each into the open bin with the least room that still takes it, else into a new bin. The
permitted sizes are optimised jointly: a new bin has the size whose cost for each word is
least when it is filled with what is left to pack; packings that open only some of the sizes are
tried as well, and the cheapest one of the block is taken. At the end every bin is downsized to
the smallest permitted capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written
from factloom.llm.words import word_counts

CAPACITIES = (256, 512, 1024, 2048)
#: Pieces in a block, about.
BLOCK_ROWS = 20_000


def cost_of(capacity: int) -> float:
    """Cost of a sequence: a fixed part, one for each place, and attention's square."""
    return 32.0 + capacity + capacity * capacity / 16384.0


def _filled(room: int, left: Counter, distinct: list[int]) -> int:
    """Words that go in ``room`` when the longest remaining piece that fits is taken again and again."""
    total, top = 0, len(distinct)
    while (top := bisect_right(distinct, room - total, 0, top)) > 0:
        length = distinct[top - 1]
        total += length * min(left[length], (room - total) // length)
        top -= 1
    return total


def best_fit(lengths: Sequence[int], size_for: Callable[[int, Counter, list[int]], int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the contents of each bin; ``size_for`` gives a new bin's size for a length and what is left."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    fill: list[int] = []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    left = Counter(lengths)
    distinct = sorted(left)
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        length = lengths[item]
        left[length] -= 1
        if not left[length]:
            distinct.pop()
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, own = size_for(length, left, distinct), len(fill)
            fill.append(0)
        bins[item], offsets[item] = own, fill[own]
        fill[own] += length
        if more := room - length:
            if not by_room.setdefault(more, []):
                insort(rooms, more)
            by_room[more].append(own)
    return bins, offsets, fill


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost_of) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the capacity of each bin; no length may exceed the largest.

    The cheapest of these packings: bins opened at the size that costs least for each word when
    filled with what is left; bins opened at the cheapest size for each place; and, for every
    choice of sizes with the largest one, bins opened at the smallest chosen size. Ties take the first.
    """
    if not lengths:
        return [], [], []
    sizes = sorted(set(capacities))

    def looking_ahead(length: int, left: Counter, distinct: list[int]) -> int:
        return min((c for c in sizes if c >= length), key=lambda c: (cost(sizes[bisect_left(sizes, full := length + _filled(c - length, left, distinct))]) / full, c))

    cheap = {size: min((c for c in sizes if c >= size), key=lambda c: (cost(c) / c, c)) for size in sizes}
    ways = [looking_ahead, lambda length, *_: cheap[sizes[bisect_left(sizes, length)]]]
    for n in range(len(sizes)):
        for some in combinations(sizes[:-1], n):
            chosen = [*some, sizes[-1]]
            ways.append(lambda length, *_, chosen=chosen: chosen[bisect_left(chosen, length)])
    found = []
    for way in ways:
        bins, offsets, fill = best_fit(lengths, way)
        own = [sizes[bisect_left(sizes, f)] for f in fill]
        found.append((bins, offsets, own))
    return min(found, key=lambda x: sum(map(cost, x[2])))


def packed(documents: DataFrame, key: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each piece: key, piece, start, n_words, bin, capacity, offset.

    ``start`` is the piece's first word in the document and ``offset`` its place in the
    bin. Every document has a row: one without words (null, empty, white space only) has
    one piece of 0 words and no bin. Null keys are packed like others, rows that repeat
    are packed as often as they come, ties in length keep the order of key and piece; an empty table gives no rows.
    Pieces are dealt over blocks by key, text, number and copy, so the same rows always meet in
    a block and neither a long document nor a key or row that repeats can fill one.
    """
    largest, kind = max(capacities), documents.schema[key].dataType.simpleString()
    typed = f"`{key}` {kind}, _tag long, _all long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2)))], names=[key, "_tag", "_all"])

    lengths = documents.select(F.col(key), F.xxhash64(text).alias("_tag"), F.col(text).alias("_text")).mapInArrow(count, typed)
    lengths = written(lengths.groupBy(key, "_tag", "_all").agg(F.count("*").alias("_copies")), "lengths")
    several = F.greatest(F.ceil(F.col("_all") / largest), F.lit(1)).cast("long")
    blocks = max(1, -(-(lengths.agg(F.sum(several * F.col("_copies"))).first()[0] or 0) // block_rows))
    run = 4096
    whole = lengths.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / run))))
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.col("_run") * run, F.least(F.col("_copies"), (F.col("_run") + 1) * run) - 1)))
    whole = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), (several - 1).cast("int"))))
    start = F.col("piece").cast("long") * largest
    block = F.pmod(F.xxhash64(key, "_tag", "piece", "_copy"), F.lit(blocks)).alias("_block")
    dealt = whole.select(key, "_tag", "_copy", block, "piece", start.alias("start"), F.least(F.col("_all") - start, F.lit(largest)).alias("n_words"))

    def fill(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "_tag", "_copy", "piece"], kind="stable", ignore_index=True)
        some = rows["n_words"] > 0
        bins, offsets, sizes = pack(rows.loc[some, "n_words"].tolist(), capacities)
        out = rows.drop(columns=["_block", "_tag", "_copy"]).assign(bin=pd.Series(pd.NA, rows.index, "Int64"), capacity=pd.Series(pd.NA, rows.index, "Int32"), offset=pd.Series(pd.NA, rows.index, "Int32"))
        out.loc[some, "bin"] = np.array(bins, np.int64) + (int(block[0]) << 32)
        out.loc[some, "capacity"] = np.array([sizes[b] for b in bins], np.int32)
        out.loc[some, "offset"] = np.array(offsets, np.int32)
        return out

    return dealt.groupBy("_block").applyInPandas(fill, f"`{key}` {kind}, piece int, start long, n_words long, bin long, capacity int, offset int")
