"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts are lower-cased and every run of other than letters and digits becomes one space.
A benchmark item is cut into overlapping windows. A window of m characters that stands in
a document with e edits at most shares at least m - q + 1 - q * e of its q-grams with it,
all within 2 * e + 1 diagonals. Shared q-grams are counted in overlapping bands of
diagonals, the bands that reach the bound are aligned within the band, and a window with
e edits at most is a match. Items under ``LEAST`` characters must stand in a document as they are, between
words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import mix

Q = 10
WINDOW = 160
#: Characters of a window for excerpts, and from one to the next: an unchanged excerpt of 79 characters holds one whole.
EXCERPT, EXCERPT_STEP = 64, 16
#: Shortest item, normalised, that may have edits; shorter ones are matched exactly.
LEAST = 32
#: Shortest item that is looked for by default; fewer characters say nothing about a leak.
SHORTEST = 10
#: Edits allowed for each character of a window.
EDITS = 0.05
#: Characters of benchmark text that are broadcast at once; a larger benchmark goes in blocks.
BLOCK_CHARS = 2_000_000
_FACTORS = mix(np.arange(1, Q + 1, dtype=np.uint64)) | np.uint64(1)
_SLOTS = 22
#: Shared q-grams of texts and windows that are laid out at once.
_HITS = 4_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, bounds of the texts, and each code's place in its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts).replace("İ", "I").lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    good = _letters()[codes]
    keep = good.copy()
    keep[:-1] |= good[1:]
    keep[bounds[:-1][sizes > 0]] = good[bounds[:-1][sizes > 0]]
    ends = bounds[1:][sizes > 0] - 1
    keep[ends] = good[ends]
    at = np.flatnonzero(keep)
    out = np.where(good[at], codes[at], 32).astype(np.uint32)
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return out, kept, at - np.repeat(bounds[:-1], np.diff(kept))


def _grams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - Q + 1, np.uint64)
    for k in range(Q):
        out += codes[k : len(codes) - Q + 1 + k].astype(np.uint64) * _FACTORS[k]
    return mix(out)


def _string(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Index:
    """Windows of benchmark items and their sorted q-grams."""

    items: list
    owner: np.ndarray
    codes: list[np.ndarray]
    grams: np.ndarray
    window: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    excerpt: np.ndarray
    tiny: ahocorasick.Automaton | None


def index_of(items: list[tuple[object, str]], excerpts: bool = False, shortest: int = SHORTEST) -> Index:
    """The index of (item key, text) pairs; texts of fewer than ``shortest`` characters are left out, those under ``Q`` are kept in an automaton."""
    codes, bounds, _ = normalised([t or "" for _, t in items])
    owner: list[int] = []
    parts: list[np.ndarray] = []
    short: list[bool] = []
    tiny: dict[str, list[int]] = {}
    for k in range(len(items)):
        own = codes[bounds[k] : bounds[k + 1]]
        if len(own) < max(shortest, 1):
            continue
        if len(own) < Q:
            tiny.setdefault(_string(own), []).append(k)
            continue
        for size, step in ((WINDOW, WINDOW // 2), *([(EXCERPT, EXCERPT_STEP)] if excerpts and len(own) > EXCERPT else [])):
            for s in sorted({*range(0, max(1, len(own) - size + 1), step), max(0, len(own) - size)}):
                owner.append(k)
                parts.append(own[s : s + size])
                short.append(size == EXCERPT)
    grams = [_grams(p) for p in parts]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    window = np.repeat(np.arange(len(parts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    slots = np.zeros(1 << _SLOTS, bool)
    slots[(flat >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
    found = ahocorasick.Automaton() if tiny else None
    for word, owners in tiny.items():
        found.add_word(f" {word} ", (len(word), owners))
    if tiny:
        found.make_automaton()
    return Index([k for k, _ in items], np.array(owner, np.int64), parts, flat[order], window[order], place[order], slots, np.array(short, bool), found)


def banded_distance(window: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int]:
    """Least edits of the whole window against any stretch of region, on diagonals low to high; its start and end.

    Diagonals are places in region minus places in window. Edits above the budget come back as budget + 1.
    """
    width, far = high - low + 1, budget + 1
    diagonals = np.arange(low, high + 1)
    row = np.where((diagonals >= 0) & (diagonals <= len(region)), 0, far).astype(np.int64)
    begin = diagonals.copy()
    steps = np.arange(width)
    for i, code in enumerate(window.tolist(), 1):
        j = diagonals + i
        inside = (j >= 0) & (j <= len(region))
        other = np.full(width, -1, np.int64)
        real = (j >= 1) & (j <= len(region))
        other[real] = region[j[real] - 1]
        best = np.where(real, row + (other != code), far)
        source = begin.copy()
        up = np.append(row[1:], far) + 1
        from_up = up < best
        best[from_up] = up[from_up]
        source[from_up] = np.append(begin[1:], 0)[from_up]
        best = np.where(inside, best, far + width)
        reach = np.minimum.accumulate(best - steps)
        left = reach + steps
        where = np.maximum.accumulate(np.where(best - steps == reach, steps, 0))
        better = left < best
        row = np.minimum(np.where(better & inside, left, best), far)
        begin = np.where(better, source[where], source)
    k = int(row.argmin())
    return int(row[k]), int(begin[k]), int(diagonals[k] + len(window))


def _parts(near: np.ndarray, count: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of hits with about ``_HITS`` shared q-grams each; a range within a text begins two windows before the last one's end."""
    total, reach, first = np.concatenate([[0], np.cumsum(count)]), 2 * (WINDOW + int(WINDOW * EDITS)), 0
    while first < len(near):
        last = max(int(np.searchsorted(total, total[first] + _HITS, "right")) - 1, int(np.searchsorted(near, near[first] + 2 * reach)))
        yield first, min(last, len(near))
        if last >= len(near):
            return
        first = int(np.searchsorted(near, near[last] - reach)) if text[last] == text[last - 1] else last


def _candidates(text: np.ndarray, at: np.ndarray, grams: np.ndarray, own: tuple[np.ndarray, ...], sizes: np.ndarray, budget: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of (text, window, band): bands with as many shared q-grams as the lemma asks for; windows are halved where there are too many."""
    of_window, windows, places = own
    first = np.searchsorted(of_window, grams, "left")
    count = np.searchsorted(of_window, grams, "right") - first
    if count.sum() > 2 * _HITS and windows.min() < windows.max():
        low = windows <= (int(windows.min()) + int(windows.max())) // 2
        for half in (low, ~low):
            yield from _candidates(text, at, grams, tuple(x[half] for x in own), sizes, budget)
        return
    hit = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window, place = windows[hit], places[hit]
    text = np.repeat(text, count)
    step = 2 * budget[window] + 1
    band = np.floor_divide(np.repeat(at, count) - place, step)
    rows = np.stack([np.concatenate([text, text]), np.concatenate([window, window]), np.concatenate([band, band - 1]), np.concatenate([place, place])])
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    rows = rows[:, fresh]
    head = np.ones(rows.shape[1], bool)
    head[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    starts = np.flatnonzero(head)
    shared = np.diff(np.append(starts, rows.shape[1]))
    bands = rows[:3, starts]
    enough = shared >= np.maximum(sizes - Q + 1 - Q * budget, 1)[bands[1]]
    yield bands[:, enough].T


def _exact(own: np.ndarray, region: np.ndarray, low: int, high: int, between_words: bool) -> tuple[int, int] | None:
    """The first place on diagonals low to high where region holds own as it is."""
    start = max(low, 0)
    stretch, wanted = region[start : high + len(own)].tobytes(), own.tobytes()
    at = stretch.find(wanted)
    while at >= 0:
        a = start + at // 4
        b = a + len(own)
        if at % 4 == 0 and not (between_words and ((a and region[a - 1] != 32) or (b < len(region) and region[b] != 32))):
            return a, b
        at = stretch.find(wanted, at + 1)
    return None


def matches(texts: list[str], index: Index, edits: float = EDITS) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): the closest matching window of each item in each text.

    Start and end are code points of the text as given, end exclusive.
    """
    if not texts or not (len(index.grams) or index.tiny):
        return []
    codes, bounds, source = normalised(texts)
    best: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
    for t in range(len(texts)) if index.tiny else ():
        for end, (size, owners) in index.tiny.iter(f" {_string(codes[bounds[t] : bounds[t + 1]])} "):
            for owner in owners:
                best.setdefault((t, owner), (False, 0, end - 1 - size, end - 1))
    grams = _grams(codes)
    near = np.flatnonzero(index.slots[(grams >> np.uint64(64 - _SLOTS)).astype(np.int64)])
    count = np.searchsorted(index.grams, grams[near], "right") - np.searchsorted(index.grams, grams[near], "left")
    near, count = near[count > 0], count[count > 0]
    text = np.searchsorted(bounds, near, "right") - 1
    whole = near + Q <= bounds[text + 1]
    near, count, text = near[whole], count[whole], text[whole]
    sizes = np.array([len(c) for c in index.codes], np.int64)
    budget = np.where(sizes < LEAST, 0, np.floor(sizes * edits)).astype(np.int64)
    for first, last in _parts(near, count, text):
        some, of_text = near[first:last], text[first:last]
        for bands in _candidates(of_text, some - bounds[of_text], grams[some], (index.grams, index.window, index.place), sizes, budget):
            for t, w, b in bands.tolist():
                own, allowed = index.codes[w], int(budget[w])
                low = b * (2 * allowed + 1)
                high = low + 2 * (2 * allowed + 1) - 1
                held = (t, int(index.owner[w]))
                kind = bool(index.excerpt[w])
                if held in best and (best[held][1] == 0 or kind > best[held][0]):
                    continue
                region = codes[bounds[t] : bounds[t + 1]]
                as_is = _exact(own, region, low, high, len(own) < LEAST)
                if as_is:
                    found = (0, *as_is)
                elif len(own) < LEAST:
                    continue
                else:
                    found = banded_distance(own, region, low, high, allowed)
                if found[0] <= allowed and found[2] > found[1] and (held not in best or (kind, *found) < best[held]):
                    best[held] = (kind, *found)
    place_of = lambda t, k: int(source[bounds[t] + k])
    return [(t, k, place_of(t, max(a, 0)), place_of(t, b - 1) + 1, d) for (t, k), (_, d, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item: str, text: str, shortest: int) -> list[Index]:
    """Indexes of blocks of the benchmark, none over ``BLOCK_CHARS`` by much; nulls take no part."""
    items = benchmark.select(F.col(item).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)))
    return [index_of([(r["k"], r["t"]) for r in dealt.where(F.col("b") == b).orderBy("k", "t").toLocalIterator()], excerpts=True, shortest=shortest) for b in range(blocks)]


def _scan(texts: pd.Series, index: Index, edits: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Matches of a batch, some texts at a time."""
    rows, held, size = [], [], 0
    for k, t in enumerate([*texts, None]):
        if k < len(texts):
            rows.append(k)
            held.append(t or "")
            size += len(held[-1])
        if held and (size > 1 << 19 or k == len(texts)):
            for t_, *found in matches(held, index, edits):
                yield rows[t_], *found
            rows, held, size = [], [], 0


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(key, item, start, end, edits): one row for each document row and benchmark item found in it.

    Documents are read whole; null and empty ones match nothing, nor do benchmark items
    under ``shortest`` normalised characters. Null document keys pass through; rows that
    repeat match repeatedly; empty tables give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    typed = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, start long, end long, edits int"
    out = None
    for index in _blocks(benchmark, item, item_text, shortest):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(batch.iloc[t, 0], shared.value.items[k], a, b, d) for t, k, a, b, d in _scan(batch.iloc[:, 1], shared.value, edits)]
                yield pd.DataFrame(rows, columns=[key, item, "start", "end", "edits"])

        part = documents.select(F.col(key), F.col(text)).mapInPandas(search, typed)
        out = part if out is None else out.unionByName(part)
    return out


def is_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS, shortest: int = SHORTEST) -> Column:
    """Whether a text holds an item of the benchmark; false for null and empty texts, and where the benchmark is empty. No shuffle."""
    spark, out = documents.sparkSession, F.lit(False)
    for index in _blocks(benchmark, item, item_text, shortest):
        out = out | _found(spark.sparkContext.broadcast(index), edits)(F.col(text))
    return out


def _found(shared: Broadcast, edits: float) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        hit[[t for t, *_ in _scan(texts, shared.value, edits)]] = True
        return pd.Series(hit)

    return found
