"""Jaccard similarity join of documents on word shingles by T-occurrence search.

1. Every text becomes the set of its distinct 5-word shingles, as 64-bit hashes. Equal sets
   are one set from here on. A fixed-size sketch counts the shingles of all texts.
2. Two sets of similarity t or more share one of each set's n - ceil(t * n) + 1 rarest shingles,
   for any common order; the sketch gives the order. However many shingles there are, one that is commoner than
   a cell's mean load ranks behind the rare ones, and those are what would make long lists. The inverted lists of these shingles are
   built; short ones are merged by counting each pair's occurrences, and pairs whose count
   and places can still reach the overlap they need are joined; so are, size band by size band, sets
   that share a long list. Sets joined directly or through others form a search group; the rest link with nothing.
3. In a group, inverted lists are searched with DivideSkip: of a set's lists the longest are put
   aside, the others are merged by a heap of their heads, sets with enough occurrences are
   kept, and the long lists are probed for these by binary search.
4. The links' connected components follow from one spanning forest a group.

What is shuffled is kept small: postings travel in compressed blocks, one for each bucket of shingles, only texts that may be in a
search group are dealt by their key, and a step's shuffle files go when the step ends.

A group with more than ``GROUP_SETS`` sets or ``GROUP_SHINGLES`` shingles is dealt into blocks by size band and by a hash, and each pair of
blocks of one band or of two neighbouring ones is searched on its own, so no task holds more than two blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import dropped, shuffles_freed, written
from factloom.llm.words import mix, shingle_sets

WIDTH = 5
#: Similarity from which two sets link, in hundredths.
PERCENT = 80
#: Sets and shingles in a block of a search group, about.
GROUP_SETS = 256
GROUP_SHINGLES = 1_000_000
#: Longest posting list of which pairs are counted.
SHORT_LIST = 16
_CELL_BITS = 22
_CHUNKS = 16
#: Posting lists held in a task before they are passed on.
_FLUSH = 1_000_000
_MEET = 200_000
#: Postings in a bucket, about; at least and at most so many bits number the buckets.
_BUCKET = 50_000
_BUCKET_BITS = (8, 16)
#: Pairs in a block of pairs that is dealt as one row.
_STARS = 4096
#: Slots of the filter of keys, by which texts that have no search group are passed over before a shuffle.
_SLOTS = 1 << 24
#: Chunks of the sketch that one task sums in the first of two rounds.
_SUMMED = 256
#: Weight of a probe against a step of the merge, in DivideSkip's choice of the long lists.
_MU = 0.02


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def _prints(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    return (int(mix(own).sum(dtype=np.uint64).astype(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))


def _packed(values: np.ndarray) -> bytes:
    """Compressed planes of the first, second, ... bytes of all values."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes | pa.Buffer, size: int, kind: type) -> np.ndarray:
    """The ``size`` values of ``_packed``."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def shingle_prints(documents: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, f, g) for each row, and the sketch of its shingles as rows with a chunk number and counts."""
    typed = f"`{key}` {documents.schema[key].dataType.simpleString()}, n int, f long, g long, chunk int, counts binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, kind = np.zeros(1 << _CELL_BITS, np.uint8), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            n, f, g = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, own in shingle_sets(batch.column(1), width):
                n[k] = len(own)
                f[k], g[k] = _prints(own)
                at = (own >> np.uint64(64 - _CELL_BITS)).astype(np.int64)
                cells[at] += cells[at] < 255
            nulls = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, f, g, nulls.cast(pa.int32()), nulls.cast(pa.binary())], names=[key, "n", "f", "g", "chunk", "counts"])
        if cells.any():
            parts = [_packed(x) for x in np.split(cells, _CHUNKS)]
            empty = pa.nulls(_CHUNKS)
            yield pa.RecordBatch.from_arrays([empty.cast(kind), *(empty.cast(t) for t in (pa.int32(), pa.int64(), pa.int64())), pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=[key, "n", "f", "g", "chunk", "counts"])

    return documents.select(key, text).mapInArrow(scan, typed)


def rarity(prints: DataFrame) -> np.ndarray:
    """For each cell of the sketch a level that rises with the number of texts that hold a shingle of it."""
    rows = prints.where("chunk IS NOT NULL").select("chunk", "counts")
    typed, cells = "chunk int, counts binary", (1 << _CELL_BITS) // _CHUNKS

    def added(batches: Iterator[pa.RecordBatch], kind: type) -> tuple[np.ndarray, set[int]]:
        total, seen = np.zeros((_CHUNKS, cells), np.int64), set()
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] += _unpacked(counts.as_buffer(), cells, kind)
                seen.add(chunk)
        return total, seen

    def chunks(total: np.ndarray, seen: set[int], kind: type) -> Iterator[pa.RecordBatch]:
        own = sorted(seen)
        yield pa.record_batch({"chunk": pa.array(own, pa.int32()), "counts": pa.array([_packed(np.minimum(total[c], np.iinfo(kind).max).astype(kind)) for c in own], pa.binary())})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunks(*added(batches, np.uint8), np.uint32)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = added(batches, np.uint32)
        yield from chunks(np.round(np.log2(1.0 + total) * 512), seen, np.uint16)

    parts = rows.repartition(rows.count() // _SUMMED + 1).mapInArrow(part, typed)
    found = parts.repartition(_CHUNKS, "chunk").mapInArrow(whole, typed).collect()
    if not found:
        return np.zeros(1 << _CELL_BITS, np.uint16)
    return np.concatenate([_unpacked(r["counts"], cells, np.uint16) for r in sorted(found, key=lambda r: r["chunk"])])


def prefix(own: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set, one of which it shares with every set it links with."""
    size = len(own) - needed(len(own), percent) + 1
    if size >= len(own):
        return own
    level = levels[(own >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
    return own[np.lexsort((own, level))[:size]]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return heads, np.diff(np.append(heads, len(values)))


def _sorted_postings(token: np.ndarray, node: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by token and node, each node once in a list."""
    order = np.lexsort((node, token))
    token, node, held = token[order], node[order], held[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    return token[fresh], node[fresh], held[fresh]


@lru_cache(maxsize=8)
def _band_starts(percent: int) -> np.ndarray:
    """Least sizes of the bands: sets of one band may link by their sizes, those two bands apart can't."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out, np.int64)


def _long_stars(token: np.ndarray, node: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in its list's size band and length of its list, for each posting; distinct pairs of nodes that join the sets of long lists.

    In a long list every node is joined with the first of its band, and two neighbouring bands by their first
    nodes if the largest set of the one may link with the least of the other.
    """
    sizes = _runs(token)[1]
    length = np.repeat(sizes, sizes)
    band = np.searchsorted(_band_starts(percent), size, "right")
    order = np.lexsort((node, band, token))
    t, b, n, x = token[order], band[order], size[order], node[order]
    head = np.ones(len(t), bool)
    head[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(head)
    runs = np.diff(np.append(heads, len(t)))
    place = np.empty(len(t), np.int64)
    place[order] = np.arange(len(t)) - np.repeat(heads, runs)
    far = length[order] > SHORT_LIST
    first = np.repeat(x[heads], runs) if len(t) else x
    some = far & ~head
    pairs = [np.stack([x[some], first[some]])]
    if len(heads) > 1:
        most, least = np.maximum.reduceat(n, heads), np.minimum.reduceat(n, heads)
        near = far[heads[1:]] & (t[heads[1:]] == t[heads[:-1]]) & (b[heads[1:]] == b[heads[:-1]] + 1) & (100 * most[:-1] >= percent * least[1:])
        pairs.append(np.stack([x[heads[1:]][near], x[heads[:-1]][near]]))
    found = np.concatenate(pairs, axis=1)
    found = np.unique(found[:, found[0] != found[1]], axis=1)
    return place, length, found[0], found[1]


def _blocks(token: np.ndarray, node: np.ndarray, held: np.ndarray, bits: int) -> pa.RecordBatch:
    """Postings in ascending order of their tokens as a row for each bucket of tokens: its number, its size, the tokens' gaps, the nodes and what is held."""
    bucket = (token.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
    heads, sizes = _runs(bucket)
    gaps = token.copy()
    gaps[1:] -= token[:-1]
    gaps[heads] = token[heads]
    packed = [_packed(np.concatenate([x[at : at + k] for x in (gaps, node, held)])) for at, k in zip(heads.tolist(), sizes.tolist(), strict=True)]
    return pa.record_batch({"bucket": bucket[heads], "size": sizes.astype(np.int32), "postings": pa.array(packed, pa.binary()), "stars": pa.nulls(len(heads), pa.binary())})


def _postings(packed: pa.Buffer, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, nodes and what is held of a block."""
    gaps, node, held = np.split(_unpacked(packed, 3 * size, np.int64), 3)
    return np.cumsum(gaps), node, held


def search_edges(documents: DataFrame, levels: np.ndarray, text: str, width: int, percent: int, shingles: int) -> DataFrame:
    """(a, b): fingerprints of sets that may link, or that a chain of such pairs joins.

    A list of up to ``SHORT_LIST`` sets gives its pairs of fitting sizes and places, and the
    occurrences of each pair are counted over all short lists; pairs whose count and last places
    can't reach the overlap they need are let go. A longer list joins its sets within their size bands.
    ``shingles`` is the number in all sets, about; by it postings are dealt into buckets.
    """
    shared = documents.sparkSession.sparkContext.broadcast(levels)
    bits = min(max((shingles * (100 - percent) // 100 // _BUCKET).bit_length(), _BUCKET_BITS[0]), _BUCKET_BITS[1])

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int64)
        return pa.record_batch({"a": a, "b": b, "c": zero - 1, "i": zero, "j": zero, "n": zero, "m": zero})

    def emit(tokens: list[np.ndarray], nodes: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        lengths = [len(t) for t in tokens]
        place = np.concatenate([np.arange(k) for k in lengths])
        held = np.repeat(np.array(sizes, np.int64) << 32, lengths) | place
        token, node, held = _sorted_postings(np.concatenate(tokens), np.repeat(np.array(nodes, np.int64), lengths), held)
        place, _, a, b = _long_stars(token, node, held >> 32, percent)
        keep = place <= SHORT_LIST
        yield _blocks(*(x[keep] for x in (token.view(np.int64), node, held)), bits)
        for at in range(0, len(a), _STARS):
            x, y = a[at : at + _STARS], b[at : at + _STARS]
            bucket = (mix(x[:1].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.record_batch({"bucket": bucket, "size": np.array([len(x)], np.int32), "postings": pa.nulls(1, pa.binary()), "stars": pa.array([np.concatenate([x, y]).tobytes()], pa.binary())})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, sizes, size = [], [], [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), width):
                if len(own):
                    tokens.append(prefix(own, shared.value, percent))
                    nodes.append(_prints(own)[0])
                    sizes.append(len(own))
                    size += len(tokens[-1])
            if size > _FLUSH:
                yield from emit(tokens, nodes, sizes)
                tokens, nodes, sizes, size = [], [], [], 0
        if tokens:
            yield from emit(tokens, nodes, sizes)

    def pairs_of(token: np.ndarray, node: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, node, held = _sorted_postings(token, node, held)
        _, length, a, b = _long_stars(token, node, held >> 32, percent)
        found = [np.stack([a, b, *np.zeros((5, len(a)), np.int64)])]
        short = (length > 1) & (length <= SHORT_LIST)
        token, node, n, i = token[short], node[short], held[short] >> 32, held[short] & 0xFFFFFFFF
        for lag in range(1, SHORT_LIST):
            x = np.flatnonzero(token[lag:] == token[:-lag])
            if not len(x):
                break
            y = x + lag
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            fits = np.minimum(n[x], n[y]) >= need
            x, y = x[fits], y[fits]
            found.append(np.stack([node[x], node[y], np.ones(len(x), np.int64), i[x], i[y], n[x], n[y]]))
        rows = np.concatenate(found, axis=1)
        if not rows.shape[1]:
            return
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        head = np.ones(rows.shape[1], bool)
        head[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
        at = np.flatnonzero(head)
        sure = np.minimum.reduceat(rows[2], at) == 0
        counted = [rows[0, at], rows[1, at], np.where(sure, -1, np.add.reduceat(rows[2], at)), *(np.maximum.reduceat(rows[k], at) for k in (3, 4, 5, 6))]
        yield pa.record_batch(dict(zip(("a", "b", "c", "i", "j", "n", "m"), counted, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, most, last = [], 0, _MEET, None
        for batch in batches:
            for bucket, k, postings, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if pairs.is_valid:
                    yield stars(*np.split(np.frombuffer(pairs.as_buffer(), np.int64), 2))
                    continue
                if bucket != last and size >= _MEET:
                    yield from pairs_of(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, size, most = [], 0, _MEET
                elif size >= 2 * most:
                    held = _sorted_postings(*map(np.concatenate, zip(*parts, strict=True)))
                    place, _, a, b = _long_stars(*held[:2], held[2] >> 32, percent)
                    yield stars(a, b)
                    parts = [tuple(x[place <= SHORT_LIST] for x in held)]
                    size = most = len(parts[0][0])
                parts.append(_postings(postings.as_buffer(), k))
                size, last = size + k, bucket
        if parts:
            yield from pairs_of(*map(np.concatenate, zip(*parts, strict=True)))

    posted = documents.select(text).mapInArrow(post, "bucket int, size int, postings binary, stars binary")
    met = posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long, c long, i long, j long, n long, m long")
    pairs = met.groupBy("a", "b").agg(F.min("c").alias("least"), F.sum("c").alias("c"), *(F.max(x).alias(x) for x in ("i", "j", "n", "m")))
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    suffix = lambda x: F.ceil(percent * F.col(x) / 100) - 1
    most = F.col("c") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"), F.greatest(suffix("n"), suffix("m")))
    return pairs.where((F.col("least") < 0) | (most >= need)).select("a", "b")


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def heap_merge(lists: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """Values that stand in ``least`` of the sorted lists or more, and in how many, from a heap of the lists' heads."""
    heap = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapify(heap)
    found, times = [], []
    while len(heap) >= least > 0:
        value, count = heap[0][0], 0
        while heap and heap[0][0] == value:
            _, k, at = heap[0]
            count += 1
            if at + 1 < len(lists[k]):
                heapreplace(heap, (lists[k][at + 1], k, at + 1))
            else:
                heappop(heap)
        if count >= least:
            found.append(value)
            times.append(count)
    return found, times


def divide_skip(sets: list[np.ndarray], asked: list[np.ndarray] | None = None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked set in turn, the places of the sets it links with; without ``asked`` each set is asked for earlier ones.

    A set of n needs T = ceil(percent / 100 * n) occurrences at least. Its L longest lists are put
    aside; the others are merged, and what occurs T - L times there is probed in the long ones.
    """
    if not sets:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    tokens, heads, lengths = np.unique(flat, return_index=True, return_counts=True)
    postings = np.repeat(np.arange(len(tokens)), lengths) * len(sets) + owner
    for r, query in enumerate(sets if asked is None else asked):
        own = np.searchsorted(tokens, query)
        inside = own < len(tokens)
        own = own[inside][tokens[own[inside]] == query[inside]]
        own = own[lengths[own] > 1] if asked is None else own
        least = needed(len(query), percent)
        if len(own) < least or not least:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        aside = min(least - 1, int(least / (_MU * np.log2(lengths[own[-1]] + 1) + 1)))
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        ends = heads[short] + lengths[short]
        lists = [owner[a:b].tolist() for a, b in zip(heads[short], ends, strict=True)]
        if asked is None:
            lists = [x[: bisect_left(x, r)] for x in lists]
        found, times = (np.array(x, np.int64) for x in heap_merge(lists, least - aside))
        fits = (100 * np.minimum(sizes[found], len(query)) >= percent * np.maximum(sizes[found], len(query))) if len(found) else np.zeros(0, bool)
        found, times = found[fits], times[fits]
        for a in range(0, len(found), 4096):
            if len(long):
                keys = long[None] * len(sets) + found[a : a + 4096, None]
                at = np.minimum(np.searchsorted(postings, keys), len(postings) - 1)
                times[a : a + 4096] += (postings[at] == keys).sum(1)
        linked = found[100 * times >= percent * (sizes[found] + len(query) - times)]
        if len(linked):
            yield r, linked


def dealt_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """``placed`` (group, node, n) with the block of each set and those it meets, its own among them.

    A small group is block 0. A larger one has blocks of its own in each size band, and sets of
    two bands meet only if the bands are neighbours, since others can't link.
    """
    load = lambda n, k: F.greatest(F.ceil(n / GROUP_SHINGLES), F.ceil(k / GROUP_SETS))
    place = lambda band, k: F.shiftleft(band.cast("long"), 32) + k
    placed = placed.withColumn("band", F.size(F.filter(F.lit(_band_starts(percent).tolist()), lambda x: x <= F.col("n"))))
    bands = placed.groupBy("group", "band").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    bands = bands.groupBy("group").agg(load(F.sum("n"), F.sum("k")).alias("whole"), F.map_from_entries(F.collect_list(F.struct("band", load(F.col("n"), F.col("k"))))).alias("blocks"))
    placed = placed.join(bands.select("group", F.when(F.col("whole") > 1, F.col("blocks")).alias("blocks")), "group")
    blocks, band, zero = F.col("blocks"), F.col("band"), F.lit(0).cast("long")
    near = F.filter(F.array(band - 1, band, band + 1), lambda b: F.map_contains_key(blocks, b))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(zero, F.try_element_at(blocks, b) - 1), lambda k: place(b, k))))
    block = place(band, F.pmod(F.xxhash64("node"), F.try_element_at(blocks, band)))
    small = blocks.isNull()
    return placed.withColumn("block", F.when(small, zero).otherwise(block)).withColumn("others", F.when(small, F.array(zero)).otherwise(others))


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_SLOTS)).cast("int")


def texts_of(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, _text): rows of ``documents`` whose key is a ``rep`` of ``wanted``, and some more; nothing is shuffled but slots of the keys."""
    slots = np.zeros(_SLOTS, bool)
    slots[wanted.select(_slot("rep").alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            found = batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))
            if len(found):
                yield pa.RecordBatch.from_arrays(found.columns[1:], names=["rep", "_text"])

    kinds = [documents.schema[x].dataType.simpleString() for x in (key, text)]
    rows = documents.where(F.col(key).isNotNull()).select(_slot(key).alias("slot"), F.col(key).alias("rep"), F.col(text).alias("_text"))
    return rows.mapInArrow(some, f"rep {kinds[0]}, _text {kinds[1]}")


def similar(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component, n_links) for every row of ``documents``.

    ``component`` is the least key that can be reached by links, and ``n_links`` (long) the number
    of other rows that the row itself links with. Words are read from whole texts and
    compared with A-Z in lower case. Null, empty and white texts have no shingles, no links and
    their own key as component. Rows with a null key have a null component and link with nothing. Rows
    that repeat link with each other; rows of one key count as one document in components.
    Other columns are not read.
    """
    with shuffles_freed(documents.sparkSession):
        return _similar(documents, key, text, width, percent)


def _similar(documents: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    prints = written(shingle_prints(documents, key, text, width), "shingles")
    sets = prints.where(f"chunk IS NULL AND `{key}` IS NOT NULL AND n > 0").select(F.col(key).alias("id"), "n", "f", "g")
    levels = rarity(prints)
    shingles = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    joined = components(search_edges(documents.where(F.col(key).isNotNull()), levels, text, width, percent, shingles))
    groups = joined.select(F.col("node").alias("f"), F.col("component").alias("group"))
    kinds = written(sets.groupBy("f", "g", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "kinds")
    placed = dealt_blocks(kinds.join(groups, "f").withColumn("node", F.struct("rep", "f", "g")), percent)
    placed = written(placed.select("rep", "node", "group", "block", "others", "copies"), "placed")
    texts = texts_of(documents, placed, key, text).join(placed, "rep")
    id_type = documents.schema[key].dataType.simpleString()
    node_type = f"struct<rep:{id_type},f:bigint,g:bigint>"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = zip(batch.column(1).field("f").to_pylist(), batch.column(1).field("g").to_pylist(), strict=True)
            wanted = dict(enumerate(wanted))
            found = [(k, own) for k, own in shingle_sets(batch.column(0), width) if len(own) and _prints(own) == wanted[k]]
            at = pa.array([k for k, _ in found], pa.int64())
            arrays = pa.array([own.tobytes() for _, own in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (1, 2, 3, 4, 5)), arrays], names=["node", "group", "block", "others", "copies", "own"])

    spread_out = texts.select("_text", "node", "group", "block", "others", "copies").mapInArrow(spread, f"node {node_type}, group long, block long, others array<long>, copies long, own binary")
    dealt = spread_out.withColumn("other", F.explode("others"))
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "own")

    def search(table: pa.Table) -> pa.Table:
        rows: dict[tuple, tuple] = {}
        nodes = table.column("node").combine_chunks()
        for at, (f, g, block, copies, own) in enumerate(zip(nodes.field("f").to_pylist(), nodes.field("g").to_pylist(), *(table.column(c).to_pylist() for c in ("block", "copies")), table.column("own"), strict=True)):
            rows.setdefault((f, g), (block, copies, at, np.frombuffer(own.as_buffer(), np.uint64)))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        kept = sorted(rows.values(), key=lambda x: len(x[3]))
        if i != j:
            kept = [x for x in kept if x[0] == i] + [x for x in kept if x[0] == j]
        first = sum(x[0] == i for x in kept)
        sets, copies = [x[3] for x in kept], np.array([x[1] for x in kept], np.int64)
        forest, links = _Forest(len(kept)), np.zeros(len(kept), np.int64)
        for r, found in divide_skip(sets, None, percent) if i == j else divide_skip(sets[:first], sets[first:], percent):
            r += 0 if i == j else first
            links[r] += copies[found].sum()
            links[found] += copies[r]
            for s in found.tolist():
                forest.join(r, s)
        at = np.array([x[2] for x in kept], np.int64)
        return pa.table({"node": nodes.take(at), "root": nodes.take(at[[forest.root(k) for k in range(len(kept))]]), "links": links})

    found = written(dealt.groupBy("group", "i", "j").applyInArrow(search, f"node {node_type}, root {node_type}, links long"), "links")
    dropped(placed)
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("component.rep").alias("component"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    kinds = kinds.withColumn("node", F.struct("rep", "f", "g")).join(links, "node", "left").join(reached, "node", "left")
    kinds = kinds.select("f", "g", "n", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    docs = prints.where("chunk IS NULL").select(F.col(key).alias("id"), "n", "f", "g")
    known = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = docs.join(kinds, ["f", "g", "n"], "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), known).alias("component"),
        F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("n_links", none)).otherwise(none).alias("n_links"),
    )
