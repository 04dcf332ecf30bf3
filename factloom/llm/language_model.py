"""Language-model scoring by Elias-Fano n-gram tries of three words, one for each shard of contexts.

Every text is read once into parts: its words as 64-bit hashes, numbered within the part. Shards of words sum their counts
over all training texts and number them, frequent ones low; each part gets the numbers and counts of its own words. Then each token goes to the shard of its two preceding words
(w1, w2); a shard has all that follows w2, builds its trie from the training tokens and scores all of them.

Levels of a trie, each one monotone sequence in Elias-Fano form: words by number; (w2, w3), with pointers to
the first successor of each w2; (w2, w1); and (context, place of w3 among the successors of w2), so the last level is relative to
the shorter context. A lookup is a search for the successor of a value in its sequence. With the words that follow go
their discounted probabilities, with the contexts what is left for the shorter context, as 16-bit
logarithms. All levels of a shard lie in one anonymous memory map.

P(w3 | w1 w2) = (c(w1 w2 w3) - d) / c(w1 w2) + d n(w1 w2) / c(w1 w2) P(w3 | w2), with n for the distinct successors and
d = 0.75; P(w3 | w2) alike; P(w3) = (c + 0.5) / (N + 0.5 (V + 1)), unknown words included. A context that training texts
don't have leaves all to the shorter one. Logarithms are summed as integers, so sums don't depend on order.

What follows a word or a pair with more than ``LIMIT`` tokens is dealt over several shards; these get the
word's counts of successors, or the pair's totals, from tables. Which pairs are such is told by a bit filter of fixed size.

Null texts are empty and have one token, their end; a null id is scored and learnt from like others; repeated rows count
each time; without training texts every token has probability 1; an empty table gives no rows; other columns are let go.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bits import bit_filter, cells, empty_filter, has
from factloom.llm.shared import dropped, written
from factloom.llm.words import byte_rows, hash_words, mix, row_chunks

DISCOUNT = 0.75
#: Tokens of a part and of a shard, about, and tokens of one word or pair that stay together.
PART = 1 << 20
SHARD = 1 << 21
LIMIT = 1 << 20
#: Words of all parts in a shard of words, about; least numbers of shards.
WORDS = 1 << 20
SHARDS = 24
#: Numbers that stand for the begin and the end of a text; those of words follow.
START, END = 0, 1
#: Steps of a quantised binary logarithm, and of a summed decimal one.
STEPS, FIXED = 2048, 1 << 20


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes, lowest first."""
    x = np.ascontiguousarray(x, np.uint64)
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    for k in range(data[0]):
        out[:, k] = own[k]
    return out.view(np.int64).ravel()


#: Lookups that are made at once.
_AT_ONCE = 1 << 17


class EliasFano:
    """An increasing sequence of integers below ``universe``: high parts in unary, low parts in as few bits as they need."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        values = np.asarray(values).astype(np.uint64)
        self.n, self.asked, self.bounds = len(values), 0, None
        self.low_bits = min(63, max(0, (universe // max(self.n, 1)).bit_length() - 1))
        self.shift, self.mask = np.uint64(self.low_bits), np.uint64((1 << self.low_bits) - 1)
        self.buckets = ((universe - 1) >> self.low_bits) + 1
        bits = np.zeros((self.n + self.buckets + 64) // 64 * 64, np.uint8)
        bits[(values >> self.shift).astype(np.int64) + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - bits.reshape(-1, 64).sum(1, dtype=np.int64))])
        places = np.arange(self.low_bits, dtype=np.uint64)
        # parts of a multiple of eight values end at whole bytes
        parts = [np.packbits(((values[k : k + (1 << 16), None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, self.n, 1 << 16)]
        self.low = np.concatenate([*parts, np.zeros(16, np.uint8)])

    def arrays(self) -> tuple[str, ...]:
        return ("high", "zeros", "low")

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        anywhere = np.ndarray((len(self.low) - 8,), np.uint64, self.low, strides=(1,))
        out = anywhere[byte] >> shift
        if self.low_bits > 56:
            out |= np.where(shift > 0, self.low[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return out & self.mask

    def _select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Places in the high parts of the ones, or zeros, of these ranks."""
        out = np.empty(len(rank), np.int64)
        before = self.zeros if not bit else 64 * np.arange(len(self.zeros)) - self.zeros
        for first in range(0, len(rank), 1 << 15):
            own = rank[first : first + (1 << 15)]
            word = np.searchsorted(before, own, "right") - 1
            inside = np.unpackbits(np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
            out[first : first + len(own)] = word * 64 + (np.cumsum(inside, axis=1, dtype=np.int8) == (own - before[word] + 1)[:, None]).argmax(1)
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at these indexes."""
        high = (self._select(index, 1) - index).astype(np.uint64)
        return ((high << self.shift) | self._low(index)).astype(np.int64)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values in the buckets before each given one: what stands before the zero that opens it."""
        self.asked += len(bucket)
        if self.bounds is None and 16 * self.asked > self.n:  # many are asked for in all, so all bounds are laid out, once
            zeros = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")[: self.n + self.buckets] == 0)
            zeros -= np.arange(len(zeros))
            self.bounds = np.zeros(len(zeros) + 1, np.int32 if self.n < 1 << 31 else np.int64)
            self.bounds[1:] = zeros
        if self.bounds is not None:
            return self.bounds[bucket].astype(np.int64)
        out = np.zeros(len(bucket), np.int64)
        some = np.flatnonzero(bucket > 0)
        out[some] = self._select(bucket[some] - 1, 0) - (bucket[some] - 1)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x in the sequence, or -1: the successor of x is searched within its bucket, for so many at once."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        if len(x) > _AT_ONCE:
            return np.concatenate([self.find(x[k : k + _AT_ONCE]) for k in range(0, len(x), _AT_ONCE)])
        x = np.asarray(x).astype(np.uint64)
        bucket = (x >> self.shift).astype(np.int64)
        inside = bucket < self.buckets
        bucket = np.minimum(bucket, self.buckets - 1)
        lo, hi = np.split(self._before(np.concatenate([bucket, bucket + 1])), 2)
        end, low = hi.copy(), x & self.mask
        while (rest := np.flatnonzero(lo < hi)).size:
            mid = (lo[rest] + hi[rest]) >> 1
            less = self._low(mid) < low[rest]
            lo[rest[less]] = mid[less] + 1
            hi[rest[~less]] = mid[~less]
        hit = inside & (lo < end)
        hit[hit] = self._low(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    """Binary logarithms of probabilities in 16 bits, 2,048 steps for a factor of two."""
    return np.clip(np.rint(-np.log2(np.maximum(p, 2.0**-31)) * STEPS), 0, 65535).astype(np.uint16)


_VALUES = np.exp2(-np.arange(65536) / STEPS)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    head = np.ones(len(columns[0]), bool)
    head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(head)


def _counted(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers below ``size``, sorted, and how often each occurs."""
    bits = max(1, (size - 1).bit_length())
    if bits * len(columns) > 63:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        at = _runs(*columns)
        return [c[at].astype(np.int64) for c in columns], np.diff(np.append(at, len(columns[0])))
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key << bits | c
    key = np.sort(key)
    at = _runs(key)
    n, key, out = np.diff(np.append(at, len(key))), key[at], []
    for _ in columns:
        out.append(key & ((1 << bits) - 1))
        key = key >> bits
    return out[::-1], n


class Trie:
    """The trie of one shard.

    ``words`` has its sorted words; ``w1, w2, w3`` are the places there of training tokens with their contexts. ``followers``
    (w2, w3, n) has the counts of the words of which the shard doesn't have all; ``pairs`` (w1, w2, total, distinct)
    those of such pairs.
    """

    def __init__(self, words: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, followers: np.ndarray, pairs: np.ndarray) -> None:
        self.words = EliasFano(words, int(words.max(initial=0)) + 1)
        self.size = max(1, len(words))
        (w2, w1, w3), c3 = _counted([w2, w1, w3], self.size)
        # successors of w2: summed here, or given
        f2, f3, fn = followers
        own = np.ones(len(w2), bool)
        if len(f2):
            own = ~np.isin(w2, np.unique(f2))
        a, b, n = np.concatenate([w2[own], f2]), np.concatenate([w3[own], f3]), np.concatenate([c3[own], fn])
        key = a * self.size + b
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = _runs(key)
        n, a, b = np.add.reduceat(n, at) if len(at) else n, *np.divmod(key[at], self.size)
        at = _runs(a)
        sizes, totals = np.diff(np.append(at, len(a))), np.add.reduceat(n, at) if len(at) else n
        self.heads = EliasFano(a[at], self.size)
        self.first = EliasFano(at, len(a) + 1)  # of each head's successors
        self.successors = EliasFano(np.repeat(np.arange(len(at)), sizes).astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64), max(1, len(at)) * self.size)
        self.p2 = quantised((n - DISCOUNT) / np.repeat(totals, sizes))
        self.left2 = quantised(DISCOUNT * sizes / totals)
        del a, b, n, key, order, own, sizes, totals
        # contexts of two words, and their successors by place among those of w2
        heads = at
        at = _runs(w1, w2)
        sizes3, totals3 = np.diff(np.append(at, len(w1))), np.add.reduceat(c3, at) if len(at) else c3
        context = w2[at].astype(np.uint64) * np.uint64(self.size) + w1[at].astype(np.uint64)
        distinct3 = sizes3.copy()
        if len(pairs[0]):
            given = pairs[1].astype(np.uint64) * np.uint64(self.size) + pairs[0].astype(np.uint64)
            new = ~np.isin(given, context)
            context, sizes3 = np.append(context, given[new]), np.append(sizes3, np.zeros(new.sum(), np.int64))
            totals3, distinct3 = np.append(totals3, pairs[2][new]), np.append(distinct3, pairs[3][new])
            order = np.argsort(context, kind="stable")
            context, sizes3, totals3, distinct3 = context[order], sizes3[order], totals3[order], distinct3[order]
            there = np.searchsorted(context, given)
            totals3[there], distinct3[there] = pairs[2], pairs[3]
        self.contexts = EliasFano(context, self.size * self.size)
        self.left3 = quantised(DISCOUNT * distinct3 / totals3)
        head = self.heads.find(w2)
        place = self.successors.find(head.astype(np.uint64) * np.uint64(self.size) + w3.astype(np.uint64)) - heads[head]
        self.width = int(place.max(initial=0)) + 1
        owner = np.repeat(np.arange(len(sizes3)), sizes3)
        self.last = EliasFano(owner.astype(np.uint64) * np.uint64(self.width) + place.astype(np.uint64), max(1, len(sizes3)) * self.width)
        self.p3 = quantised((c3 - DISCOUNT) / np.repeat(totals3, sizes3))
        self._map()

    def _map(self) -> None:
        """Lay all arrays out in one memory map."""
        held = [(self, k) for k in ("p2", "left2", "left3", "p3")]
        held += [(x, k) for x in (self.words, self.heads, self.first, self.successors, self.contexts, self.last) for k in x.arrays()]
        sizes = [-(-getattr(x, k).nbytes // 8) * 8 for x, k in held]
        self.levels = mmap.mmap(-1, max(8, sum(sizes)))
        at = 0
        for (x, k), size in zip(held, sizes, strict=True):
            own = getattr(x, k)
            view = np.frombuffer(self.levels, own.dtype, len(own), at)
            view[:] = own
            setattr(x, k, view)
            at += size

    def probabilities(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """P(w3 | w1 w2) of words by their places, -1 if not known, with the probability of each w3 alone."""
        size = np.uint64(self.size)
        out = lowest.astype(float)
        own, back = np.unique(w2, return_inverse=True)
        head = np.where(own >= 0, self.heads.find(np.maximum(own, 0)), -1)[back]
        known = np.flatnonzero(head >= 0)
        place = np.full(len(w1), -1)
        some = known[w3[known] >= 0]
        place[some] = self.successors.find(head[some].astype(np.uint64) * size + w3[some].astype(np.uint64))
        out[known] *= _VALUES[self.left2[head[known]]]
        hit = place >= 0
        out[hit] += _VALUES[self.p2[place[hit]]]
        some = known[w1[known] >= 0]
        own, back = np.unique(w2[some].astype(np.uint64) * size + w1[some].astype(np.uint64), return_inverse=True)
        context = self.contexts.find(own)[back]
        some, context = some[context >= 0], context[context >= 0]
        out[some] *= _VALUES[self.left3[context]]
        ok = hit[some]
        some, context = some[ok], context[ok]
        own, back = np.unique(head[some], return_inverse=True)
        relative = (place[some] - self.first.at(own)[back]).astype(np.uint64)
        near = relative < np.uint64(self.width)
        some, context, relative = some[near], context[near], relative[near]
        found = self.last.find(context.astype(np.uint64) * np.uint64(self.width) + relative)
        out[some[found >= 0]] += _VALUES[self.p3[found[found >= 0]]]
        return np.minimum(out, 1.0)


def _parts(documents: DataFrame, kind: str, most: int) -> DataFrame:
    """(part, ids, train, sizes, words, counts, trained, tokens, …): texts in parts of about ``most`` words, words numbered by frequency."""
    names = ["part", "ids", "train", "sizes", "words", "counts", "trained", "tokens", "n_docs", "n_train", "n_words"]

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, train, hashes, sizes, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def part() -> pa.RecordBatch:
            flags, size = np.concatenate(train), np.concatenate(sizes)
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(tokens, minlength=len(words))
            trained = np.bincount(tokens[np.repeat(flags, size)], minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            binary = [pa.array([x], pa.binary()) for x in (flags.tobytes(), pack(size), words[order].tobytes(), pack(counts[order]), pack(trained[order]), pack(rank[tokens]))]
            return pa.RecordBatch.from_arrays([pa.array([number]), lists, *binary, pa.array([len(own)]), pa.array([int(flags.sum())]), pa.array([len(words)])], names=names)

        for batch in batches:
            data, offsets = byte_rows(batch.column(2))
            for first, last in row_chunks(offsets):
                own = offsets[first : last + 1]
                words, bounds = hash_words(data[own[0] : own[-1]], own - own[0])
                ids.append(batch.column(0).slice(first, last - first))
                train.append(batch.column(1).slice(first, last - first).to_numpy(zero_copy_only=False).astype(bool))
                hashes.append(words)
                sizes.append(np.diff(bounds))
                held += len(words)
                if held >= most or sum(map(len, ids)) >= most:
                    yield part()
                    number, ids, train, hashes, sizes, held = number + 1, [], [], [], [], 0
        if ids:
            yield part()

    typed = f"part long, ids array<{kind}>, train binary, sizes binary, words binary, counts binary, trained binary, tokens binary, n_docs long, n_train long, n_words long"
    return documents.mapInArrow(lay_out, typed)


def _by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a part's words by their shards, and the shards in that order."""
    shard = (mix(words) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, shard[order]


def _counts_of(parts: DataFrame, shards: int, limit: int) -> DataFrame:
    """Numbers and counts of each part's words, for one shard of words after the other; for each shard its sums, and its words with over ``limit`` tokens."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, counts, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(words, np.uint64)
                order, shard = _by_shard(h, shards)
                h, n, c = h[order], unpack(counts)[order], unpack(trained)[order]
                at = np.append(_runs(shard), len(shard))
                for a, b in zip(at[:-1], at[1:], strict=True):
                    columns = [h[a:b].tobytes(), pack(n[a:b]), pack(c[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])]), pa.array([part]), *(pa.array([x], pa.binary()) for x in columns)], names=["shard", "part", "words", "n", "c"])

    def sum_up(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n, c = (np.bincount(at, np.concatenate([unpack(x) for x in table.column(k).to_pylist()])).astype(np.int64) for k in ("n", "c"))
        order = np.argsort(-n, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words)) * shards + shard + 2
        ends = np.cumsum([len(h) for h in hashes])
        own = [at[e - len(h) : e] for e, h in zip(ends, hashes, strict=True)]
        hot = np.flatnonzero(n > limit)
        null = [None] * len(own)
        rows = {
            "part": [*table.column("part").to_pylist(), None, *[None] * len(hot)], "shard": [shard] * (len(own) + 1 + len(hot)),
            "numbers": [*(pack(number[x]) for x in own), None, *[None] * len(hot)], "c": [*(pack(c[x]) for x in own), None, *[None] * len(hot)], "n": [*(pack(n[x]) for x in own), None, *[None] * len(hot)],
            "known": [*null, int(c.sum()), *[None] * len(hot)], "tokens": [*null, int(n.sum()), *[None] * len(hot)], "distinct": [*null, int((c > 0).sum()), *[None] * len(hot)],
            "hot": [*null, None, *number[hot].tolist()], "hot_n": [*null, None, *n[hot].tolist()],
        }
        return pa.table({k: pa.array(v, pa.binary() if k in ("numbers", "c", "n") else pa.int64()) for k, v in rows.items()})

    dealt = parts.select("part", "words", "counts", "trained").mapInArrow(deal, "shard long, part long, words binary, n binary, c binary")
    return written(dealt.groupBy("shard").applyInArrow(sum_up, "part long, shard long, numbers binary, c binary, n binary, known long, tokens long, distinct long, hot long, hot_n long"), "words")


def _with_counts(parts: DataFrame, counts: DataFrame, shards: int, kind: str) -> DataFrame:
    """Parts whose words are numbers, with their counts in training texts and in all texts."""

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        order, _ = _by_shard(np.frombuffer(left.column("words")[0].as_py(), np.uint64), shards)
        rows = np.argsort(right.column("shard").to_numpy(), kind="stable")
        columns = []
        for name in ("numbers", "c", "n"):
            own = right.column(name).to_pylist()
            out = np.empty(len(order), np.int64)
            out[order] = np.concatenate([unpack(own[k]) for k in rows] or [np.zeros(0, np.int64)])
            columns.append(pa.array([pack(out)], pa.binary()))
        return pa.Table.from_arrays([left.column(k) for k in ("part", "ids", "train", "sizes", "tokens")] + columns, names=["part", "ids", "train", "sizes", "tokens", "numbers", "c", "n"])

    kept = parts.select("part", "ids", "train", "sizes", "words", "tokens")
    own = counts.where("part IS NOT NULL").select("part", "shard", "numbers", "c", "n")
    both = kept.groupBy("part").cogroup(own.groupBy("part"))
    return written(both.applyInArrow(assemble, f"part long, ids array<{kind}>, train binary, sizes binary, tokens binary, numbers binary, c binary, n binary"), "counted")


def _context(row: dict) -> dict:
    """Tokens of a part with their contexts: places w1, w2, w3 in the part's table of words, where 0 is the begin and 1 the end of a text; documents; numbers, counts."""
    sizes, docs = unpack(row["sizes"]), len(row["ids"])
    ends = np.cumsum(sizes + 1)
    w3 = np.ones(int(ends[-1]) if docs else 0, np.int32)
    inside = np.ones(len(w3), bool)
    inside[ends - 1] = False
    w3[inside] = unpack(row["tokens"]) + 2
    doc = np.repeat(np.arange(docs, dtype=np.int32), sizes + 1)
    w2, w1 = np.zeros_like(w3), np.zeros_like(w3)
    w2[1:], w1[2:] = w3[:-1], w3[:-2]
    starts = ends - sizes - 1
    w2[starts], w1[starts] = 0, 0
    w1[starts[sizes > 0] + 1] = 0
    return {"w": (w1, w2, w3), "doc": doc, "train": np.frombuffer(row["train"], bool), "numbers": np.append([START, END], unpack(row["numbers"])), "c": unpack(row["c"]), "n": unpack(row["n"])}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(len(batch)):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _spread(n: np.ndarray, limit: int) -> np.ndarray:
    """Number of shards over which what follows a word or pair with n tokens is dealt."""
    return np.maximum(1, -(-n // limit))


def _shard(w2: np.ndarray, sub: np.ndarray, shards: int) -> np.ndarray:
    return (mix(mix(w2.view(np.uint64)) + sub.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _route(part: dict, n_docs: int, pairs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the part of w2's shards it goes to, and whether it follows a common pair."""
    (w1, w2, w3), numbers = part["w"], part["numbers"]
    spread = _spread(np.append([n_docs, 0], part["n"]), limit)
    sub, common = np.zeros(len(w2), np.int64), np.zeros(len(w2), bool)
    some = np.flatnonzero((spread > 1)[w2])
    a, b, c = (numbers[x[some]].view(np.uint64) for x in (w1, w2, w3))
    common[some] = has(pairs, cells(np.zeros(len(some), np.uint64), [a, b]))
    key = mix(a)
    sub[some] = (np.where(common[some], mix(key ^ c), key) % spread[w2[some]].astype(np.uint64)).astype(np.int64)
    return sub, common


def scored(documents: DataFrame, train: Column, key: str = "doc_id", text: str = "text", part: int = PART, limit: int = LIMIT) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every document; the model is learnt from rows where ``train``.

    ``part`` and ``limit`` are numbers of tokens: of a part, and of a word or pair whose successors stay together.
    """
    kind = documents.schema[key].dataType.simpleString()
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    parts = written(_parts(rows, kind, part), "parts")
    n_docs, n_train, n_words = (x or 0 for x in parts.agg(F.sum("n_docs"), F.sum("n_train"), F.sum("n_words")).first())
    word_shards = max(SHARDS, -(-n_words // WORDS))
    words = _counts_of(parts, word_shards, limit)
    counted = _with_counts(parts, words, word_shards, kind)
    dropped(parts)
    known, all_, distinct = (x or 0 for x in words.agg(F.sum("known"), F.sum("tokens"), F.sum("distinct")).first())
    total, size = known + n_train, distinct + (n_train > 0)
    shards = max(SHARDS, -(-(all_ + n_docs) // SHARD))
    scale = total + 0.5 * (size + 1)

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = _context(row)
                _, w2, w3 = own["w"]
                some = (_spread(np.append([n_docs, 0], own["n"]), limit) > 1)[w2]
                trained = some & own["train"][own["doc"]]
                for kept, name in ((some, "n"), (trained, "c")):
                    (a, b), n = _counted([w2[kept], w3[kept]], len(own["numbers"]))
                    yield pa.record_batch({"w2": own["numbers"][a], "w3": own["numbers"][b], "n": n if name == "n" else n * 0, "c": n if name == "c" else n * 0})

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = _context(row)
                some = _route(own, n_docs, pair_bits.value, limit)[1] & own["train"][own["doc"]]
                w, n = _counted([x[some] for x in own["w"]], len(own["numbers"]))
                yield pa.record_batch({f"w{k + 1}": own["numbers"][x] for k, x in enumerate(w)} | {"n": n})

    # words with more tokens than stay together: all shards that have a part of what follows them get the counts of their successors
    hot = words.where("hot IS NOT NULL").select(F.col("hot").alias("w2"), F.col("hot_n").alias("n"))
    if n_docs > limit:
        hot = hot.unionByName(spark.createDataFrame([(START, n_docs)], "w2 long, n long"))
    given, pair_bits = None, spark.sparkContext.broadcast(empty_filter())
    if not hot.isEmpty():
        spread = hot.select("w2", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / limit).cast("long") - 1)).alias("sub"))
        follow = written(counted.mapInArrow(successors, "w2 long, w3 long, n long, c long").groupBy("w2", "w3").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "followers")
        common = follow.where(F.col("n") > limit).select(F.col("w2").alias("w1"), F.col("w3").alias("w2"))
        if n_docs > limit:
            common = common.unionByName(spark.createDataFrame([(START, START)], "w1 long, w2 long"))
        pair_bits = spark.sparkContext.broadcast(bit_filter(common.withColumn("kind", F.lit("")), "kind", ["w1", "w2"]))
        given = follow.where("c > 0").join(spread, "w2").select("w2", "sub", "w3", F.col("c").alias("total"), F.lit(None).cast("long").alias("w1"), F.lit(None).cast("long").alias("kinds"))
        if not common.isEmpty():
            three = counted.mapInArrow(triples, "w1 long, w2 long, w3 long, n long").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
            two = three.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            given = given.unionByName(two.join(spread, "w2").select("w2", "sub", F.lit(None).cast("long").alias("w3"), "total", "w1", "kinds"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = _context(row)
                numbers, c = own["numbers"], np.append([0, n_train], own["c"])
                w1, w2, w3 = own["w"]
                shard = _shard(numbers, np.zeros(len(numbers), np.int64), shards)[w2].astype(np.int32)
                sub = _route(own, n_docs, pair_bits.value, limit)[0]
                some = np.flatnonzero(sub)
                shard[some] = _shard(numbers[w2[some]], sub[some], shards)
                del sub, some
                order = np.lexsort((w3, w1, w2)) if len(numbers) >= 1 << 21 else np.argsort((w2.astype(np.int64) << 42) | (w1.astype(np.int64) << 21) | w3, kind="stable")
                order = order[np.argsort(shard[order].astype(np.uint16) if shards < 1 << 16 else shard[order], kind="stable")]
                shard, tokens = shard[order], [x[order] for x in own["w"]]
                doc = own["doc"][order] * 2 + own["train"][own["doc"][order]]
                at = np.append(_runs(shard), len(shard))
                place = np.zeros(len(numbers), np.int64)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    used = np.zeros(len(numbers), bool)
                    for x in tokens:
                        used[x[a:b]] = True
                    used = np.flatnonzero(used)
                    used = used[np.argsort(numbers[used])]
                    place[used] = np.arange(len(used))
                    columns = [pack(np.diff(numbers[used], prepend=0)), pack(c[used]), *(pack(place[x[a:b]]) for x in tokens), pack(doc[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])]), pa.array([row["part"]]), *(pa.array([x], pa.binary()) for x in columns)], names=["shard", "part", "words", "c", "w1", "w2", "w3", "doc"])

    def search(table: pa.Table) -> pa.Table:
        here = table.filter(pc.is_valid(table.column("part")))
        extra = table.select(["g1", "g2", "g3", "total", "kinds"]).filter(pc.is_null(table.column("part")))
        g1, g2, g3, totals, kinds = (c.fill_null(0).to_numpy().astype(np.int64) for c in extra.columns)
        pair = pc.is_valid(extra.column("g1")).to_numpy()
        numbers = [np.cumsum(unpack(x)) for x in here.column("words").to_pylist()]
        counts = [unpack(x) for x in here.column("c").to_pylist()]
        trained = [h[(c > 0) | (h == START)] for h, c in zip(numbers, counts, strict=True)]
        words = np.unique(np.concatenate([*trained, g1[pair], g2, g3[~pair]]))
        ids = lambda h: np.searchsorted(words, h).astype(np.int64)
        # a shard may have several parts of a word, each with the same totals
        follow, pairs = np.stack([ids(g2[~pair]), ids(g3[~pair]), totals[~pair]]), np.stack([ids(g1[pair]), ids(g2[pair]), totals[pair], kinds[pair]])
        follow, pairs = (x[:, np.unique(x[0] * max(1, len(words)) + x[1], return_index=True)[1]] for x in (follow, pairs))
        def tokens(k: int) -> tuple[list[np.ndarray], np.ndarray]:
            return [unpack(here.column(f"w{i}")[k].as_py()) for i in (1, 2, 3)], unpack(here.column("doc")[k].as_py())

        learnt: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in range(3)]
        for k, h in enumerate(numbers):
            w, doc = tokens(k)
            place, some = ids(h).astype(np.int32), (doc & 1) > 0
            for own, x in zip(learnt, w, strict=True):
                own.append(place[x[some]])
        trie = Trie(words, *map(np.concatenate, learnt), follow, pairs)
        del learnt
        out = []
        for k, (number, h, c) in enumerate(zip(here.column("part").to_pylist(), numbers, counts, strict=True)):
            w, doc = tokens(k)
            place = trie.words.find(h)
            w1, w2, w3 = (place[x] for x in w)
            c, doc = c[w[2]], doc >> 1
            at = _runs(*w)  # a block is sorted by its words
            p = trie.probabilities(w1[at], w2[at], w3[at], (c[at] + 0.5) / scale)
            fixed = np.repeat(np.rint(np.log10(p) * -FIXED), np.diff(np.append(at, len(w1))))
            docs = np.flatnonzero(np.bincount(doc))
            out.append((number, pack(np.diff(docs, prepend=0)), pack(np.bincount(doc, fixed)[docs].astype(np.int64))))
        columns = list(zip(*out, strict=True)) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "doc", "sum"])

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = _context(row)
                c = np.append([0, n_train], own["c"])[own["w"][2]]
                docs = len(row["ids"])
                at = np.searchsorted(own["doc"], np.arange(docs))
                sums = [np.add.reduceat(x, at) if docs else x for x in (np.ones(len(c), np.int64), (c > 0).astype(np.int64), np.log10((c + 0.5) / scale))]
                lists = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), batch_ids(batch, row["part"]))
                columns = [row["train"], pack(sums[0]), pack(sums[1]), sums[2].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]]), lists, *(pa.array([x], pa.binary()) for x in columns)], names=["part", "ids", "train", "n_tokens", "n_known", "base"])

    def batch_ids(batch: pa.RecordBatch, number: int) -> pa.Array:
        k = batch.column(batch.schema.get_field_index("part")).to_pylist().index(number)
        return batch.column(batch.schema.get_field_index("ids"))[k].values

    def gather(table: pa.Table) -> pa.Table:
        own = next(k for k, x in enumerate(table.column("base").to_pylist()) if x is not None)
        ids = table.column("ids")[own].values
        get = lambda name: table.column(name)[own].as_py()
        sums = np.zeros(len(ids), np.int64)
        for doc, value in zip(table.column("doc").to_pylist(), table.column("sum").to_pylist(), strict=True):
            if doc is not None:
                sums[np.cumsum(unpack(doc))] += unpack(value)
        columns = [ids, pa.array(np.frombuffer(get("train"), bool)), pa.array(unpack(get("n_tokens"))), pa.array(unpack(get("n_known"))), pa.array(np.full(len(ids), total)), pa.array(np.frombuffer(get("base"), float)), pa.array(-sums / FIXED)]
        return pa.Table.from_arrays(columns, names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    columns = ["shard", "part", "words", "c", "w1", "w2", "w3", "doc"]
    blocks = counted.mapInArrow(deal, "shard long, part long, words binary, c binary, w1 binary, w2 binary, w3 binary, doc binary")
    extra = ["g1", "g2", "g3", "total", "kinds"]
    blocks = blocks.select(*columns, *(F.lit(None).cast("long").alias(c) for c in extra))
    if given is not None:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w2, sub = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(_shard(w2, sub, shards)), *(batch.column(k) for k in (4, 0, 2, 3, 5))], names=["shard", *extra])

        placed = given.select("w2", "sub", "w3", "total", "w1", "kinds").mapInArrow(place, f"shard long, {', '.join(f'{c} long' for c in extra)}")
        blocks = blocks.unionByName(placed, allowMissingColumns=True)
    sums = blocks.groupBy("shard").applyInArrow(search, "part long, doc binary, sum binary")
    own = counted.mapInArrow(base, f"part long, ids array<{kind}>, train binary, n_tokens binary, n_known binary, base binary")
    both = own.unionByName(sums, allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(gather, f"{key} {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
